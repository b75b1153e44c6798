"""What the operators share: a checkpoint folder, checked broadcasts, runs of sorted rows, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; beyond it a shuffle join runs.
BROADCAST_ROWS = 1_000_000
#: Rows of one key that a task may get in a join.
HOT = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where it is unset, one is made: in local mode a temporary
    folder, else one in the warehouse."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not where:
        where = sc.getCheckpointDir() or ""
    if not where:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        where = tempfile.mkdtemp(prefix="checkpoint-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoint"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder: computed once, and kept when an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast if the rows (of a few numbers each) are counted to be at most ``limit``.  ``df`` should be
    checkpointed, so that the count is cheap."""
    return F.broadcast(df) if df.count() <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def spread_copies(rows: DataFrame, most: int, piece: int = 4_000) -> DataFrame:
    """Each row as often as ``copies`` says (at most ``most``), numbered by ``copy`` from 0; a row with very many is dealt
    to several tasks before it is repeated."""
    start = F.lit(0).cast("long")
    if most > piece:
        rows = rows.withColumn("_from", F.explode(F.sequence(start, F.col("copies") - 1, F.lit(piece).cast("long")))).repartition(*rows.columns[:3], "_from")
    else:
        rows = rows.withColumn("_from", start)
    last = F.least(F.col("copies"), F.col("_from") + piece) - 1
    return rows.withColumn("copy", F.explode(F.sequence(F.col("_from"), last))).drop("_from")


def spread_join(rows: DataFrame, side: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` left-joined with ``side`` on ``key``, a binary column that is unique in ``side``, of which ``n`` tells
    how many rows it meets.  No task gets all rows of one key: a side of few rows is broadcast; of a larger one, the keys
    with more than ``HOT`` rows are, and their rows and those without a key are spread over the join of the others.
    ``side`` should be checkpointed."""
    others = [c for c in side.columns if c != key]
    if side.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), key, "left")
    hot = side.where(F.col(n) > HOT).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in others])
    found = rows.join(checked_broadcast(cut(hot)), F.col(key) == F.col("_hot"), "left")
    # Eight bytes equal no key of sixteen.
    salted = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(F.unhex(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")))
    found = found.withColumn("_salted", salted)
    cold = side.where(F.col(n) <= HOT).withColumnRenamed(key, "_salted")
    both = found.join(cold, "_salted", "left")
    return both.select(*rows.columns, *[F.coalesce(c, f"_hot_{c}").alias(c) for c in others])


def give_back() -> None:
    """Returns freed memory to the system.  Python workers live on between tasks, and what their allocators keep would
    count against the executor's other work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over batches; at a task's end its freed memory goes back.  Arrow takes its memory from the C
    library, like numpy, so that nothing freed is kept in a pool of its own."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        give_back()

    return wrapped


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys, from batches sorted by them."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component): the smallest node of each connected component, for every node with an edge.

    Alternating large-star and small-star steps over a distributed edge table; each step is checkpointed, and the
    work ends when a step changes nothing.  The number of steps is about the logarithm of the diameter; ``most`` only
    guards against an endless loop and raises.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = _mark(e)
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = cut(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        now = _mark(e)
        if now == mark:
            return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {most} steps")


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first())
