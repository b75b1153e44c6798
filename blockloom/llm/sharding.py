"""Sharding by longest-processing-time scheduling under the ``bytes`` law: shards of near equal size.

Rows with equal texts stay together.  Groups go, largest first, to the shard with the fewest bytes so far, kept in a
heap; ties go to the smaller shard number and, among groups of one size, to the smaller digest.

The schedule depends on sizes alone, so groups of one size are scheduled as one run.  Sizes that differ add up: there
are at most sqrt(2 * bytes of all texts) of them, and that bounds what the driver holds (about 14 million numbers for
100 TB).  A run of more groups than shards is not walked through: while the least loaded shards catch up with the next
one they take turns, so the shard of a run's r-th group follows from the loads before the run.  The driver tells each
run's loads, or its few shards, and every group finds its place by its rank in its run.

Ranks and slots are counted in parts of about ``PART``, each after the ones before it; no part is a whole size or a
whole shard.  Rows that repeat id and text are one row with a count until the very end.

A null text has no bytes and is grouped by its id alone (it equals no text); empty texts are equal to each other.
Null ids and repeated rows are rows like others.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.cluster import checked_broadcast, cut, spread_copies, tidy

#: Rows that are numbered together.
PART = 4_000
#: Groups with more rows than this are joined by a broadcast: there are few of them.
HOT = 10_000
#: Bytes that a row takes besides its text.
OVERHEAD = 16


def turns(loads: np.ndarray, size: int, ranks: np.ndarray) -> np.ndarray:
    """The shards of a run's groups, given the loads before the run, the size of its groups and the ranks asked for.

    The r-th group takes the r-th smallest of all (load + i * size, shard).  Once the first m shards, in order of load,
    are the only ones below the next, they take turns in the order of their next loads.
    """
    shards = len(loads)
    by_load = np.lexsort((np.arange(shards), loads))
    load = loads[by_load]
    # taken[m][j]: groups that shard j takes before the m-th shard, in order of load, takes its first.
    gap = load[:, None] - load[None, :]
    ties = (gap % size == 0) & (by_load[None, :] < by_load[:, None])
    taken = np.where(np.arange(shards)[None, :] < np.arange(shards)[:, None], -(-gap // size) + ties, 0)
    starts = taken.sum(axis=1)
    phase = np.searchsorted(starts, ranks, side="right") - 1
    out = np.zeros(len(ranks), np.int64)
    for m in np.unique(phase).tolist():
        here = phase == m
        following = load[: m + 1] + taken[m, : m + 1] * size
        order = by_load[: m + 1][np.lexsort((by_load[: m + 1], following))]
        out[here] = order[(ranks[here] - starts[m]) % (m + 1)]
    return out


def schedule(sizes: np.ndarray, counts: np.ndarray, shards: int) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """(size, groups, shards of the groups, loads before them) for runs of groups, sizes falling.  A run of at most
    ``shards`` groups tells their shards, a longer one the loads."""
    heap = [(0, s) for s in range(shards)]
    for size, n in zip(sizes.tolist(), counts.tolist(), strict=True):
        if n <= shards:
            picks = []
            for _ in range(n):
                load, shard = heap[0]
                picks.append(shard)
                heapq.heapreplace(heap, (load + size, shard))
            yield size, n, picks, []
            continue
        loads = np.zeros(shards, np.int64)
        for load, shard in heap:
            loads[shard] = load
        yield size, n, [], loads.tolist()
        # Whole turns of all shards first, then what is left of a turn.
        by_load = np.lexsort((np.arange(shards), loads))
        level = loads[by_load]
        low, high = 0, int(n)
        while low < high:  # the most whole levels above the least load that n groups fill
            mid = (low + high + 1) // 2
            counted = int(np.maximum(0, -(-(level[0] + mid * size - level) // size)).sum())
            low, high = (mid, high) if counted <= n else (low, mid - 1)
        full = np.maximum(0, -(-(level[0] + low * size - level) // size))
        heap = [(int(load + k * size), int(s)) for load, k, s in zip(level, full, by_load, strict=True)]
        heapq.heapify(heap)
        for _ in range(int(n - full.sum())):
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + size, shard))


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, shard) from (digest, bytes, rank, picks, loads)."""
    for batch in batches:
        rank, size = batch.column("rank").to_numpy(), batch.column("bytes").to_numpy()
        out = np.full(len(rank), -1, np.int64)
        picks, loads = batch.column("picks"), batch.column("loads")
        some = np.asarray(picks.value_lengths().fill_null(0)) > 0
        at = np.asarray(picks.offsets)[:-1] - np.asarray(picks.offsets)[0]
        values = np.asarray(picks.flatten())
        out[some] = values[(at + rank)[some]] if len(values) else 0
        many = np.flatnonzero(~some)
        for value in np.unique(size[many]).tolist():
            of = many[size[many] == value]
            out[of] = turns(np.asarray(loads[int(of[0])].values), value, rank[of])
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(out.astype(np.int32))], names=["digest", "shard"])


def _parts(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / PART)).cast("long")


def ranked(groups: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds each group's rank by digest among the groups of its size: in parts of the digest's range."""
    part = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * _parts(F.col("groups")) / F.lit(1 << 32)).cast("long")
    parted = groups.join(checked_broadcast(runs), "bytes").withColumn("part", part)
    before = Window.partitionBy("bytes").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parted.where(F.col("groups") > PART).groupBy("bytes", "part").agg(F.count("*").alias("n"))
    starts = cut(counts.select("bytes", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    within = F.row_number().over(Window.partitionBy("bytes", "part").orderBy("digest")) - 1
    numbered = parted.withColumn("within", within).join(checked_broadcast(starts), ["bytes", "part"], "left")
    return numbered.withColumn("rank", (F.col("within") + F.coalesce("start", F.lit(0))).cast("long"))


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        # Of a null text: the digest of its id, in a form that no text's digest has.
        F.coalesce(F.sha2(text.cast("binary"), 256), F.concat(F.sha2(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"), 256), F.lit(" null"))).alias("digest"),
    )
    rows = cut(rows.groupBy("doc_id", "size", "text_crc32", "digest").agg(F.count("*").alias("copies")))
    groups = cut(rows.groupBy("digest").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("n")))
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("groups"), F.sum("n").alias("n")).toPandas().sort_values("bytes", ascending=False)
    told = schedule(sizes["bytes"].to_numpy(np.int64), sizes["groups"].to_numpy(np.int64), shards)
    size, count, picks, loads = zip(*told, strict=True) if len(sizes) else ((), (), (), ())
    table = pa.table({"bytes": pa.array(size, pa.int64()), "groups": pa.array(count, pa.int64()), "picks": pa.array(picks, pa.list_(pa.int32())), "loads": pa.array(loads, pa.list_(pa.int64()))})
    runs = cut(spark.createDataFrame(table))
    placed = ranked(groups, runs).select("digest", "bytes", "rank", "picks", "loads").mapInArrow(tidy(_place), "digest string, shard int")
    placed = cut(placed.join(groups.select("digest", "n"), "digest"))
    # A group with many rows is found by a broadcast, so no task gets all rows of one; the others by a shuffle.
    hot = checked_broadcast(cut(placed.where(F.col("n") > HOT).select("digest", F.col("shard").alias("_hot"))))
    found = rows.join(hot, "digest", "left")
    rest = found.where("_hot is null").drop("_hot").join(placed.where(F.col("n") <= HOT).select("digest", "shard"), "digest")
    columns = ["doc_id", "size", "text_crc32", "digest", "copies", "shard"]
    rows = found.where("_hot is not null").withColumnRenamed("_hot", "shard").select(columns).unionByName(rest.select(columns))
    # Parts of shards, and the rows before each.
    parts = max(1, -(-int(sizes["n"].sum()) // (PART * shards)))
    rows = cut(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(parts)).cast("int")))
    counted = rows.groupBy("shard", "part").agg(F.sum("copies").alias("n"))
    start = counted.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    before = Window.partitionBy("shard", "part").orderBy("doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("within", F.coalesce(F.sum("copies").over(before), F.lit(0))).join(start, ["shard", "part"])
    numbered = numbered.withColumn("slot", (F.col("start") + F.col("within")).cast("long"))
    each = spread_copies(numbered.select("slot", "shard", "doc_id", "size", "text_crc32", "copies"), rows.agg(F.max("copies")).first()[0] or 1, PART)
    return each.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("copy")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

