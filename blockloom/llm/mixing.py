"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Each source has a weight; together the targets are all the words there are.  Sources whose share of what is left would
pass ``most`` times their own words stop there, and the excess goes to the others by weight, until none is above.  A
round is one aggregation over the sources, which says how many words and how much weight of either kind there are; the
level that follows is one number.  Nothing but the order of the sources, which gives them their weights, is sorted, and
that by ranges.

The mix takes whole repetitions of every document and, for what is left, a fraction of them: a source's documents are
dealt by a seeded hash into groups of about ``GROUP``, in a group they are in hash order, and the first ones that make
up the fraction of the group's words are taken once more, the last of them in part.  So every group, and with it the
source, comes to its target within a word a group, no group is large, and a rerun takes the same.

Documents without words (null or empty text) take 0; a source with no words has target 0.  A null source is a source
of its own, ordered last.  Rows equal in id, source and size (repeated rows, null ids) are one row with a count until
the end, so they may be any number; which of them is taken once more is not defined, and changes nothing in the result.
An empty table gives an empty result.  Other columns are ignored; ``repeated`` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.cluster import BROADCAST_ROWS, checked_broadcast, cut, fresh, spread_copies

#: Documents of one source that are ordered together.
GROUP = 2_000
#: Pieces that a source is dealt to in a join with too many sources to broadcast.
SALTS = 64

WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text_col: str = "text"):
    """Runs of anything but the six white-space characters."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")


def _placed(sources: DataFrame) -> DataFrame:
    """Adds ``place``, the number of sources before, in code-point order, null last: sorted by ranges."""
    ranged = sources.repartitionByRange(F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source"))
    ranged = cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(parts), "_part").withColumn("place", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def targets(sources: DataFrame, weights: Sequence[float], most: float = 3.0) -> DataFrame:
    """From one row a source (source, words and others): weight, target and epochs (target / words) beside them.

    Weights repeat along the sources in code-point order, null last.
    """
    named = cut(_placed(sources).withColumn("_w", (F.col("place") % len(weights)).cast("int")).drop("place"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_w") + 1)
    cap = F.col("words") * float(most)
    level, clamped = 0.0, -1
    while True:
        # Whole numbers by weight: the sums are the same in every run.
        stops = F.lit(False) if clamped < 0 else weight * F.lit(level) >= cap
        sums = named.groupBy("_w", stops.alias("stops")).agg(F.sum("words").alias("words"), F.count("*").alias("n")).collect()
        now = sum(r["n"] for r in sums if r["stops"])
        if now == clamped:
            break
        clamped = now
        free = sum(r["n"] * float(weights[r["_w"]]) for r in sorted(sums) if not r["stops"])
        if not free:
            break
        level = (sum(r["words"] for r in sums) - float(most) * sum(r["words"] for r in sums if r["stops"])) / free
    target = F.when(weight * F.lit(level) >= cap, cap).otherwise(weight * F.lit(level))
    told = named.withColumn("weight", weight).withColumn("target", target).drop("_w")
    return told.withColumn("epochs", F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size and copies (rows equal in these), computed once: the texts are read no more."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"))
    return cut(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")))


def _grouped(rows: DataFrame, weights: Sequence[float], most: float, seed: int) -> DataFrame:
    """Rows of ``sized`` with their source's words, target and epochs, what their group takes once more (share) and the
    group's words before them (before)."""
    words = F.col("size") * F.col("copies")
    per_source = rows.groupBy("source").agg(F.sum(words).alias("words"), F.count("*").alias("docs"))
    plan = cut(targets(per_source, weights, most)).withColumnRenamed("source", "_source")
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")))
    if plan.count() <= BROADCAST_ROWS // 10:
        joined = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_source")))
    else:
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("salt")))
    joined = joined.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.ceil(F.col("docs") / GROUP).cast("long")))
    in_group = Window.partitionBy("source", "bucket")
    before = F.coalesce(F.sum(words).over(in_group.orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.round((F.col("epochs") - F.floor("epochs")) * F.sum(words).over(in_group)).cast("long")
    return joined.select("doc_id", "source", "size", "copies", F.col("words").alias("source_size"), "target", F.floor("epochs").alias("whole"), share.alias("share"), before.alias("before"))


def mix(rows: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 11) -> DataFrame:
    """Per row of the documents of ``sized``: doc_id, source, size, source_size, target, taken (words, repeats counted)."""
    grouped = _grouped(rows, weights, most, seed)
    each = spread_copies(grouped, rows.agg(F.max("copies")).first()[0] or 1)
    once_more = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("share") - F.col("before") - F.col("copy") * F.col("size")))
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + once_more).cast("long").alias("taken"))


def repeated(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, in whole documents; those without words go.

    A document that is taken in part counts as taken once more from half of it on, so a source may miss its target by
    half a document a group.  Rows equal in id, source and size share what they are given: each gets the whole part,
    and one more if a hash of its place in the table falls into the fraction that is left.
    """
    rows = sized(docs, id_col, text_col, source_col)
    words = F.col("size") * F.col("copies")
    more = F.greatest(F.lit(0).cast("long"), F.least(words, F.col("share") - F.col("before")))
    times = _grouped(rows, weights, most, seed).where("size > 0").withColumn("times", F.col("whole") + more / words)
    times = times.withColumn("times", F.when(F.col("copies") == 1, F.round("times")).otherwise(F.col("times"))).where("times > 0")
    i, s, n, t, size, copy = (fresh(docs, x) for x in ("id", "source", "size", "times", "words", "copy"))
    times = cut(times.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(n), F.col("times").alias(t)))
    same = F.col(id_col).eqNullSafe(F.col(i)) & F.col(source_col).cast("string").eqNullSafe(F.col(s)) & (F.col(size) == F.col(n))
    place = fresh(docs, "place")
    matched = docs.withColumn(size, n_words(text_col)).withColumn(place, F.monotonically_increasing_id()).join(checked_broadcast(times), same)
    drawn = F.pmod(F.xxhash64(F.lit(seed + 2), F.col(place)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    often = (F.floor(t) + (drawn < F.col(t) - F.floor(t)).cast("int")).cast("int")
    matched = matched.withColumn(t, often).where(F.col(t) > 0)
    return matched.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(t)))).select(*[F.col(f"`{c}`") for c in docs.columns])
