"""Document fingerprints by a threshold-scaled sketch, in DataFrame operations only.

The sketch of a text is every 64-bit hash of its word shingles (five words, lower-cased A-Z) that falls below a fixed
fraction of the hash range, one in ``ONE_IN``, whatever the length of the text.  Sketches of parts merge by union, and
as the fraction is the same for all, the share of a small text's hashes in a large one's estimates containment however
unequal they are.  Beside it is a hash of the text's words in order, so that texts with equal words are known as equal.

Likeness is the share of the hashes of either sketch that both have, an estimate of the Jaccard similarity J from about
n / ``ONE_IN`` hashes, n being the size of the union: its standard error is sqrt(J * (1 - J) * ``ONE_IN`` / n) at most,
0.05 for 400 shingles, 0.1 for 100, 0.3 for ten.  Texts with equal words have likeness 1; different texts of which no
hash is kept, as of most texts below four shingles, have likeness 0.

A fingerprint is the words' hash and then the sketch in hexadecimal, 16 digits a hash, in ascending order; equal texts
have equal fingerprints.  A text of fewer than five words is one shingle; null and empty texts, and texts without
words, have the empty fingerprint.  The likeness of two empty fingerprints is 1, of an empty and another 0.

The neighbour of a document is the next one in descending id (the first after the last; a single row's is itself).
Equal ids are ordered by a hash of the text, falling, and null ids come last.  Rows that repeat id and text are one row
with a count until the end: each copy's neighbour is the next copy.  Ids are cut into ranges of about ``RANGE_BYTES``,
an id with many texts and the null ids into ranges of the hash; each range is ordered by itself and gets the first row
of the next.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.cluster import checked_broadcast, cut

#: One hash in so many is kept.
ONE_IN = 4
SHINGLE = 5
#: Text that is ordered together, and rows that are repeated by one task.
RANGE_BYTES = 32 << 20
PIECE = 4_000
#: Quantiles of the id; what lies between two is cut evenly.
CELLS = 256

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: xxhash64 is signed: hashes lie between -2^63 and 2^63 - 1.
_BELOW = -(1 << 63) + (1 << 64) // ONE_IN


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(words: Column, k: int = SHINGLE) -> Column:
    """Hashes of the runs of k words, in order."""
    full = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(k)]))
    short = F.array(F.xxhash64(F.lit(k), F.concat_ws(" ", words)))
    return F.when(F.size(words) >= k, full).when(F.size(words) > 0, short).otherwise(F.array().cast("array<bigint>"))


def sketch(text: Column, k: int = SHINGLE) -> Column:
    """(hashes, words): the hashes below the threshold, distinct and ascending, and the hash of all words (null if there
    is none)."""

    def of(w: Column) -> Column:
        kept = F.filter(shingle_hashes(w, k), lambda x: x < F.lit(_BELOW))
        return F.struct(F.array_sort(F.array_distinct(kept)).alias("hashes"), F.when(F.size(w) > 0, F.xxhash64(w)).alias("words"))

    # The words are bound once: a lambda's argument is evaluated one time.
    return F.element_at(F.transform(F.array(words_of(text)), of), 1)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: of the hashes of either sketch, the share that both have."""

    def of(p: Column) -> Column:
        both = F.size(F.array_intersect(p["a"]["hashes"], p["b"]["hashes"]))
        return F.struct(p["a"]["words"].eqNullSafe(p["b"]["words"]).alias("same"), both.alias("both"), (F.size(p["a"]["hashes"]) + F.size(p["b"]["hashes"]) - both).alias("either"))

    counts = F.element_at(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), of), 1)

    def share(c: Column) -> Column:
        return F.when(c["same"], F.lit(1.0)).when(c["either"] > 0, c["both"] / c["either"]).otherwise(F.lit(0.0))

    return F.element_at(F.transform(F.array(counts), share), 1).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null if none of a's is kept."""
    x = a["hashes"]
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, b["hashes"])) / F.size(x))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together, whose words have no one order."""
    return F.struct(F.array_sort(F.array_union(a["hashes"], b["hashes"])).alias("hashes"), F.lit(None).cast("bigint").alias("words"))


def spelt(s: Column) -> Column:
    """A fingerprint in hexadecimal."""
    hashes = F.array_join(F.transform(s["hashes"], lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return F.concat(F.coalesce(F.lpad(F.hex(s["words"]), 16, "0"), F.lit("")), hashes)


def _counted(rows: DataFrame) -> tuple[DataFrame, list[int], bool]:
    """Distinct rows (doc_id, text, copies, h); the few ids with very many rows; whether any id repeats."""
    total = rows.count()
    repeated = cut(rows.groupBy(F.col("doc_id").alias("_r")).agg(F.count("*").alias("_n")).where("_n > 1"))
    some = not repeated.isEmpty()
    if some:
        marked = rows.join(checked_broadcast(repeated), F.col("doc_id").eqNullSafe(F.col("_r")) & F.col("_n").isNotNull(), "left")
        once = marked.where("_n is null").select("doc_id", "text", F.lit(1).cast("long").alias("copies"))
        rows = once.unionByName(marked.where("_n is not null").groupBy("doc_id", "text").agg(F.count("*").alias("copies")))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    hot = [r["_r"] for r in repeated.where((F.col("_n") > max(1, total // CELLS)) & F.col("_r").isNotNull()).collect()]
    return rows.withColumn("h", F.xxhash64("text")), hot, some


def _range(ids: DataFrame, hot: list[int]) -> Column:
    """The number of a row's range, rising with (doc_id, h); null ids are below all."""
    told = ids.agg(F.percentile_approx("doc_id", [i / CELLS for i in range(1, CELLS)], 10_000).alias("q"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum(F.octet_length("text")).alias("bytes")).first()
    pieces = max(1, -(-(told["bytes"] or 0) // (RANGE_BYTES * CELLS)))
    by_hash = F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * (pieces * CELLS)).cast("long")
    if told["low"] is None:
        return by_hash
    # The first ids of the cells; an id with very many rows is a cell.
    last = (1 << 63) - 1
    cuts = sorted({told["low"], *(told["q"] or []), *hot, *[x + 1 for x in hot if x < last]})
    ends = [*cuts[1:], told["high"] + 1]
    bounds = F.array(*[F.lit(int(x)).cast("long") for x in cuts])
    widths = F.array(*[F.lit(float(max(1, b - a))) for a, b in zip(cuts, ends, strict=True)])
    alone = F.array(*[F.lit(x in set(hot)) for x in cuts])
    cell = F.size(F.filter(bounds, lambda x: x <= F.col("doc_id")))
    within = F.floor((F.col("doc_id").cast("double") - F.element_at(bounds, cell).cast("double")) * pieces / F.element_at(widths, cell)).cast("long")
    piece = F.when(F.element_at(alone, cell), by_hash).otherwise(F.least(within, F.lit(pieces - 1).cast("long")))
    return F.when(F.col("doc_id").isNull(), by_hash).otherwise(cell.cast("long") * F.lit(1 << 40) + piece)


def with_next(rows: DataFrame, hot: list[int]) -> DataFrame:
    """Rows (doc_id, text, copies, h) with their sketch and with ``next_text`` and ``next_sketch`` of the next row in
    descending (doc_id, h), around in a ring.  Texts are shuffled once, and a sketch is made after that."""
    key = F.struct("doc_id", "h")
    ranged = rows.withColumn("_range", _range(rows, hot))
    # Each range's first row is needed by the range above it, the first of all by the lowest.
    tops = ranged.groupBy("_range").agg(F.max(key).alias("_top"))
    ring = Window.partitionBy(F.lit(0))
    tops = tops.select(F.col("_range").alias("_of"), "_top", F.coalesce(F.lead("_range").over(ring.orderBy("_range")), F.min("_range").over(ring)).alias("_for"))
    ranged = ranged.join(checked_broadcast(cut(tops)), F.col("_range") == F.col("_of"))
    here, there = F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy")), F.struct(F.col("_for").alias("r"), F.lit(1).alias("copy"))
    place = F.explode(F.when(key.eqNullSafe(F.col("_top")), F.array(here, there)).otherwise(F.array(here)))
    placed = ranged.withColumn("_at", place).select("doc_id", "text", "copies", "h", F.col("_at.r").alias("_r"), F.col("_at.copy").alias("_copy")).repartition("_r")
    sketched = placed.withColumn("sketch", sketch(F.col("text")))
    in_range = Window.partitionBy("_r").orderBy("_copy", F.desc_nulls_last("doc_id"), F.desc("h"), "text")
    named = sketched.select("*", *[F.lead(c).over(in_range).alias(f"next_{c}") for c in ("text", "sketch")])
    return named.where("_copy = 0").drop("_r", "_copy", "h")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, sketch, next row's sketch, the edited text and its sketch.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many (or all) of the next
    document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows, hot, repeats = _counted(rows)
    rows = with_next(rows, hot)
    if repeats:
        # All copies but the last have a copy of themselves next.
        own = F.struct((F.col("copies") - 1).alias("n"), F.col("text").alias("t"), F.col("sketch").alias("s"))
        after = F.struct(F.lit(1).cast("long").alias("n"), F.col("next_text").alias("t"), F.col("next_sketch").alias("s"))
        kinds = F.explode(F.when(F.col("copies") > 1, F.array(after, own)).otherwise(F.array(after)))
        rows = rows.withColumn("_k", kinds).select("doc_id", "text", "sketch", F.col("_k.n").alias("_n"), F.col("_k.t").alias("next_text"), F.col("_k.s").alias("next_sketch"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"), *(["_n"] if repeats else []))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    if not repeats:
        return rows
    # A row that repeats very often is spread over tasks before it is repeated.
    some = rows.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(PIECE).cast("long"))))
    often = some.where(F.col("_n") > PIECE).repartition("doc_id", "_from")
    spread = some.where(F.col("_n") <= PIECE).unionByName(often)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("_n") - F.col("_from"), F.lit(PIECE).cast("long"))))
    return spread.withColumn("_copy", times).drop("_n", "_from", "_copy")
