"""N-gram Jaccard join by set-relation skipping.

Documents are sets of word shingles; two link when ``100 * |A & B| >= percent * |A | B|``.  The join is exact.

1. One pass counts in how many places each shingle occurs (about 2 bytes a shingle are shuffled).  The most frequent ones,
   at most ``FREQUENT_LIMIT`` of them, are broadcast.  They only set the order of the index, never drop anything.
2. A second pass gives each document its size, a digest of its set, a parity sketch (as many bits as are needed to tell
   sets that are too different) and its prefix: the first shingles in the order rare before frequent.  Equal sets are one class from here on.
3. Prefix shingles are the index lists.  Lists with one entry go; a document with fewer than ``SHARED`` entries left
   can link with nothing and goes too.  A list is sorted by size, each size cut into blocks by position; whole blocks
   are skipped where size or position rules every entry out (index-level skipping), and the parity sketch bounds the
   difference of a pair that is left.  A long list is dealt out as pairs of its blocks.
4. What is left forms small groups of similar sets.  In a group the first set's overlaps with all others are counted
   from the lists; those of a similar set are derived from them by the few shingles in which the two differ
   (answer-level skipping).  Only a spanning forest of the links leaves the task, so a group of copies costs as many
   rows as it has members.
5. Connected components of these links, with the members of the classes, are the result.

Null or empty text has no set and links with nothing; equal texts, or texts with equal sets, always share a component.
Rows with a null id keep it and join the component of their set.  Repeated rows are returned as often as they occur and
compared once.  An id is one document: if it comes with several texts that have words, the one whose set has the
smallest digest is compared, and all rows of the id share its component.
Shingles are compared by 64-bit hashes, the same in every run; different shingles of equal hash would count as one.
Columns of the input other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm import text as T
from blockloom.llm.cluster import checked_broadcast, components, cut, give_back, runs, spread_join, tidy

#: A shingle in more places than this is late in the index order.
FREQUENT = 16
#: At most so many frequent shingles are broadcast (16 bytes each).
FREQUENT_LIMIT = 1 << 20
#: Linked sets share at least so many prefix shingles (fewer, if they are smaller).
SHARED = 8
#: Longest list, or group in shingles, that one task holds; longer ones are dealt out as pairs of blocks.
LIST_BLOCK = 2048
GROUP_BLOCK = 1 << 19
#: In a list, entries of one size are cut into blocks of so many positions.
POSITIONS = 8


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingles, offsets), chunk by chunk."""
    for lo, hi, buf, off in T.chunks(batch.column(1)):
        word, _, _, word_off = T.words(buf, off)
        yield lo, hi, *T.distinct(*T.shingles(word, word_off, k))


def _class(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of a shingle, and 24 more bits of it, as one number: what is counted.  As there are more parts with
    more data, the share of shingles that fall together by chance stays small; they are only ordered together."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32) << np.uint64(32)) | (h & np.uint64(0xFFFFFF))


def _gaps(v: np.ndarray) -> np.ndarray:
    """Sorted numbers as 16-bit steps; a step of 65535 goes on."""
    step = np.diff(v.astype(np.int64), prepend=0)
    n = step // 65535 + 1
    out = np.full(n.sum(), 65535, np.uint16)
    out[np.cumsum(n) - 1] = step % 65535
    return out


def _from_gaps(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.int64)[steps != 65535]


def frequent_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Classes of the most frequent shingles (sorted), their counts, and the number of parts; counted over all rows."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            c = np.concatenate(held)
            c.sort()
            part = (c >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            low = [_gaps(x & np.uint64(0xFFFFFF)) for x in np.split(c, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array([x.tobytes() for x in low], pa.binary())], names=["part", "shingles"])

        for batch in batches:
            for _, _, h, _ in _sets(batch, k):
                if len(h):
                    held.append(_class(h, parts))
                    n += len(h)
                if n > 2 << 20:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        v = np.concatenate([_from_gaps(np.frombuffer(x.as_py(), np.uint16)) for x in table.column("shingles")])
        v.sort()
        at = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        n = np.diff(np.append(at, len(v)))
        often = n > FREQUENT
        found = pa.table({"shingle": pa.array((np.uint64(part) << np.uint64(32) | v[at][often].astype(np.uint64)).astype(np.int64)), "n": pa.array(n[often].astype(np.int64))})
        give_back()
        return found

    top = (
        docs.mapInArrow(tidy(send), "part long, shingles binary")
        .groupBy("part")
        .applyInArrow(count, "shingle long, n long")
        .orderBy(F.desc("n"), "shingle")
        .limit(FREQUENT_LIMIT)
        .toPandas()
        .sort_values("shingle")
    )
    return top["shingle"].to_numpy(np.uint64), top["n"].to_numpy(np.int64), parts


def _parity(h: np.ndarray, percent: int) -> bytes:
    """A power of two bits: the parities of the shingles that fall on each.  Sets that differ in d shingles differ in d
    bits at most; unrelated ones differ in half the bits, so a little over twice the largest d that links is enough."""
    bits = max(64, 1 << int(np.ceil(np.log2(max(1, 4.4 * len(h) * (100 - percent) / (100 + percent))))))
    odd = np.bincount((h >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _signatures(k: int, percent: int, frequent, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_n = frequent.value
        seen = np.zeros(1 << 20, bool)
        seen[(hot & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            for lo, hi, h, off in _sets(batch, k):
                n_of = np.zeros(len(h), np.int64)
                if len(hot) and len(h):
                    c = _class(h, parts)
                    maybe = np.flatnonzero(seen[(c & np.uint64((1 << 20) - 1)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(hot, c[maybe]), len(hot) - 1)
                    n_of[maybe] = np.where(hot[at] == c[maybe], hot_n[at], 0)
                size = np.diff(off)
                least = -(-size * percent // 100)
                length = np.where(size > 0, size - least + np.minimum(SHARED, least), 0)
                prefix, digest, parity = [], [], []
                for a, b, p in zip(off[:-1].tolist(), off[1:].tolist(), length.tolist(), strict=True):
                    s, n = h[a:b], n_of[a:b]
                    rare = np.flatnonzero(n == 0)[:p]
                    if len(rare) < p:
                        often = np.flatnonzero(n)
                        rare = np.concatenate((rare, often[np.argsort(n[often], kind="stable")][: p - len(rare)]))
                    prefix.append(s[rare])
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    parity.append(_parity(s, percent))
                values = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
                at = np.zeros(hi - lo + 1, np.int64)
                np.cumsum(length, out=at[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(digest, pa.binary()), pa.array(parity, pa.binary()), T.ragged(values.astype(np.int64), at, pa.int64())],
                    names=["id", "size", "digest", "parity", "prefix"],
                )

    return run


def _folded(parity: list[bytes]) -> tuple[np.ndarray, int]:
    """The sketches, folded to the shortest one's length, as rows of words; and that length in bits."""
    rows = [np.frombuffer(p, np.uint64) for p in parity]
    n = min(map(len, rows))
    return np.stack([np.bitwise_xor.reduce(r.reshape(-1, n), axis=0) for r in rows]), n * 64


def _position_blocks(size: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end entries of the blocks of a list in order of size and position: one size, near positions."""
    at = np.flatnonzero((np.diff(size) != 0) | (np.diff(pos // POSITIONS) != 0)) + 1
    return np.concatenate(([0], at)), np.concatenate((at, [len(size)]))


def _open_blocks(percent: int, size: int, pos: int, sizes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which blocks (size, least and greatest position) may hold an entry that links with this one: what is left after
    the common shingle bounds the overlap, and no entry's bound is above its block's."""
    need = -(-percent * (size + sizes) // (100 + percent))
    return np.flatnonzero(np.minimum(size - pos, sizes - low) + np.minimum(pos, high) >= need)


def _candidates(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From list entries sorted by list: a spanning forest of each list's candidate pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["shingle", "cell"]):
            n = group.num_rows
            if n < 2:
                continue
            ids, size, pos = (group.column(c).to_numpy() for c in ("rep", "size", "pos"))
            order = np.lexsort((pos, size))
            ids, size, pos = ids[order], size[order].astype(np.int64), pos[order].astype(np.int64)
            raw = group.column("parity").to_pylist()
            raw = [raw[i] for i in order]
            root = np.arange(n)
            found_a, found_b = [], []
            first, ends = _position_blocks(size, pos)
            low, high = pos[first], pos[ends - 1]
            for i in range(n - 1):
                # Sizes: only entries up to size * 100 / percent can link.
                end = int(np.searchsorted(size, size[i] * 100 // percent, side="right"))
                if end <= i + 1:
                    continue
                # Blocks that position rules out are skipped before their entries are touched.
                a, z = np.searchsorted(first, i + 1, side="right") - 1, np.searchsorted(first, end)
                blocks = a + _open_blocks(percent, size[i], pos[i], size[first[a:z]], low[a:z], high[a:z])
                if not len(blocks):
                    continue
                j = np.concatenate([np.arange(max(first[b], i + 1), ends[b]) for b in blocks])
                need = -(-percent * (size[i] + size[j]) // (100 + percent))
                # The same bound, entry by entry.
                most = np.minimum(size[i] - pos[i], size[j] - pos[j]) + np.minimum(pos[i], pos[j])
                j = j[(most >= need) & (root[j] != root[i])]
                if not len(j):
                    continue
                sketch, _ = _folded([raw[i], *[raw[x] for x in j]])
                apart = np.bitwise_count(sketch[1:] ^ sketch[0]).sum(axis=1)
                j = j[apart <= size[i] + size[j] - 2 * (-(-percent * (size[i] + size[j]) // (100 + percent)))]
                for x in j.tolist():
                    if root[x] != root[i]:
                        root[root == root[x]] = root[i]
                        found_a.append(i)
                        found_b.append(x)
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(ids[found_a]), pa.array(ids[found_b])], names=["a", "b"])

    return run


def links_within(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a group's sets (index pairs), by answer-level skipping.

    The group's index lists hold, for each shingle, the sets that have it.  ``overlap`` holds the current set's
    overlaps with every set; moving on to a similar set changes it only by the lists of the shingles that differ.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    token = values[start]
    end = np.append(start[1:], len(values))
    of = [np.searchsorted(token, s) for s in sets]
    many = end - start > 1

    def add(overlap: np.ndarray, tokens: np.ndarray, sign: int) -> None:
        for t in tokens[many[tokens]].tolist():
            overlap[owner[start[t] : end[t]]] += sign

    root = np.arange(n)
    forest: list[tuple[int, int]] = []
    todo = np.ones(n, bool)
    overlap = np.zeros(n, np.int64)
    at = int(np.argmax(np.bincount(owner[np.repeat(many, end - start)], minlength=n)))
    before: np.ndarray | None = None
    while True:
        if before is None:
            overlap[:] = 0
            add(overlap, of[at], 1)
        else:
            add(overlap, np.setdiff1d(before, of[at], assume_unique=True), -1)
            add(overlap, np.setdiff1d(of[at], before, assume_unique=True), 1)
        overlap[at] = size[at]
        linked = np.flatnonzero(100 * overlap >= percent * (size[at] + size - overlap))
        for x in linked.tolist():
            if root[x] != root[at]:
                root[root == root[x]] = root[at]
                forest.append((at, x))
        todo[at] = False
        if not todo.any() or (root == root[0]).all():
            return forest
        # The next set: the unfinished one that differs least from this one.
        apart = np.where(todo, size[at] + size - 2 * overlap, np.iinfo(np.int64).max)
        before = of[at]
        overlap[at] = many[before].sum()  # the lists of its own shingles were never added
        nxt = int(np.argmin(apart))
        if apart[nxt] >= size[nxt]:
            before = None
        at = nxt


def _links(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["component", "cell"]):
            if group.num_rows < 2:
                continue
            ids = group.column("id").to_numpy()
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("shingles")]
            if pairs := links_within(ids, sets, percent):
                i, j = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

    return run


def _cells(df: DataFrame, block: str, blocks: str) -> DataFrame:
    """Each row once for every pair of blocks that its block is in."""
    at = F.col(block)
    other = F.explode(F.expr(f"sequence(0L, {blocks} - 1)")).alias("_other")
    return df.select("*", other).withColumn("cell", F.least(at, F.col("_other")) * F.lit(1 << 31) + F.greatest(at, F.col("_other"))).drop("_other")


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles (set size), component_id (smallest id reachable by links, itself
    included) and class_id (smallest id with an equal set).  Nothing is linked through null or empty texts."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    hot, hot_n, parts = frequent_shingles(docs, k)
    frequent = spark.sparkContext.broadcast((hot, hot_n))
    signed = cut(docs.mapInArrow(tidy(_signatures(k, percent, frequent, parts)), "id long, size long, digest binary, parity binary, prefix array<long>"))
    # The rows of an id share the set that counts for it (own).
    repeated = cut(signed.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    repeats = not repeated.isEmpty()
    if repeats:
        chosen = signed.where("size > 0").join(checked_broadcast(repeated), "id").groupBy("id").agg(F.min("digest").alias("chosen"))
        chosen = checked_broadcast(cut(chosen))
        signed = signed.join(chosen, "id", "left").withColumn("own", F.coalesce("chosen", F.expr("if(size > 0, digest, null)"))).drop("chosen")
    else:
        signed = signed.withColumn("own", F.expr("if(size > 0, digest, null)"))
    # Sets of more than one row, and one row each of the sets to compare: most rows are no copies and stay where they are.
    classes = cut(signed.where("own is not null").groupBy("own").agg(F.min("id").alias("rep"), F.count("*").alias("members")).where("members > 1 and rep is not null"))
    compared = spread_join(signed.where("id is not null and own = digest"), classes, "own", "members")
    once = compared.where("rep is null").withColumn("rep", F.col("id"))
    first = once.unionByName(compared.where("rep = id").dropDuplicates(["rep"])).select("rep", "size", "parity", "prefix")

    # Index lists with two entries at least, of documents with enough of them.
    entry = first.select("rep", F.posexplode("prefix").alias("pos", "shingle"))
    entry = entry.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("shingle"))).where("n > 1")
    least = F.least(F.lit(SHARED), F.expr(f"int(ceil({percent} * size / 100))"))
    listed = entry.groupBy("rep").agg(F.collect_list(F.struct("shingle", "pos")).alias("listed"))
    entry = listed.join(first.select("rep", "size", "parity"), "rep").where(F.size("listed") >= least).select("rep", "size", "parity", F.inline("listed"))
    # The first shared shingle of two linked sets is in the shorter prefix that does without SHARED.
    entry = entry.where(f"pos <= size - int(ceil({percent} * size / 100))")
    by_list = Window.partitionBy("shingle")
    entry = entry.withColumn("n", F.count(F.lit(1)).over(by_list)).where("n > 1")
    entry = entry.withColumn("block", F.when(F.col("n") <= LIST_BLOCK, F.lit(0).cast("long")).otherwise(F.expr(f"pmod(xxhash64(rep), int(ceil(n / {LIST_BLOCK})))").cast("long")))
    entry = _cells(entry, "block", f"greatest(1L, cast(ceil(n / {LIST_BLOCK}) as long))")
    entry = entry.select("shingle", "cell", "rep", "size", "pos", "parity")
    sorted_lists = entry.repartition("shingle", "cell").sortWithinPartitions("shingle", "cell")
    candidates = sorted_lists.mapInArrow(tidy(_candidates(percent)), "a long, b long")

    # Groups of candidates, their whole sets, the links among them.
    groups = components(candidates).select(F.col("node").alias("id"), "component")
    groups = cut(groups.join(first.select(F.col("rep").alias("id"), "size"), "id"))
    groups = groups.withColumn("blocks", F.expr(f"cast(ceil(sum(size) over (partition by component) / {GROUP_BLOCK}) as long)"))
    groups = cut(groups.withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as long)")).select("id", "component", "block", "blocks"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, off in _sets(batch, k):
                digest = [xxhash.xxh3_128_digest(h[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(digest, pa.binary()), T.blobs(h, off)], names=["id", "digest", "shingles"])

    asked = checked_broadcast(groups)
    members = docs.join(asked.select("id"), "id", "left_semi").select("id", "text").mapInArrow(tidy(whole), "id long, digest binary, shingles binary")
    if repeats:
        members = members.join(chosen, "id", "left")
        several = members.where("chosen is not null and digest = chosen").dropDuplicates(["id"])
        members = members.where("chosen is null").unionByName(several)
    members = _cells(members.join(asked, "id"), "block", "blocks")
    dealt = members.select("component", "cell", "id", "shingles").repartition("component", "cell").sortWithinPartitions("component", "cell", "id")
    links = dealt.mapInArrow(tidy(_links(percent)), "a long, b long")
    joined = cut(components(links).select(F.col("node").alias("rep"), "component"))

    # Members of classes; most documents are the only one of their class and of their component.
    told = cut(classes.join(joined, "rep", "left").select("own", "rep", "members", "component"))
    out = spread_join(signed.select("id", "size", "own"), told, "own", "members")
    alone = checked_broadcast(joined.select(F.col("rep").alias("_id"), F.col("component").alias("_component")))
    out = out.join(alone, F.when(F.col("rep").isNull() & F.col("own").isNotNull(), F.col("id")) == F.col("_id"), "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("size").alias("n_shingles"),
        F.coalesce("component", "rep", "_component", "id").alias("component_id"),
        F.coalesce("rep", "id").alias("class_id"),
    )
