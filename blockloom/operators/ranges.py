"""Range algebra: clipping, splitting, coalescing, gaps, and joins of intervals.

Extents are rows (disk_id, start, length, kind); ranges are half-open.  Everything stays inside a disk, and what depends
on the rows before is computed in stretches of ``WIDTH`` of a disk's order: a window in each stretch, and one over a row
a stretch that carries on what the stretches before it leave.  So a large disk is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.binary import is_multiple


def end_of(start: str = "start", length: str = "length") -> Column:
    return F.col(start) + F.col(length)


#: Offsets (or numbers, where rows are ordered by one) of a disk that are ordered together.
WIDTH = 1 << 34


def _dealt(rows: DataFrame, order: str, width: int) -> DataFrame:
    return rows.withColumn("_b", F.floor(F.col(order) / width))


def _carried(rows: DataFrame, key: str, left: Column, carry: Callable[[Column], Column]) -> DataFrame:
    """Adds ``_carried`` to dealt rows: what ``carry``, an aggregate over the stretches before, makes of what each of
    them leaves."""
    before = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    stretch = rows.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_s")).agg(left.alias("_left")).select("_k", "_s", carry(F.col("_left")).over(before).alias("_carried"))
    return rows.join(stretch, F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_s"))).drop("_k", "_s")


def preceded(rows: DataFrame, key: str, order: list[str], columns: list[str], width: int = 0) -> DataFrame:
    """Adds ``_before``, the columns of the row before in the disk's order, null at its first."""
    told = F.struct(*columns)
    dealt = _carried(_dealt(rows, order[0], width or WIDTH), key, F.max_by(told, F.struct(*order)), lambda x: F.last(x, ignorenulls=True))
    within = F.lag(told).over(Window.partitionBy(key, "_b").orderBy(*order))
    return dealt.withColumn("_before", F.coalesce(within, F.col("_carried"))).drop("_carried", "_b")


def running(rows: DataFrame, key: str, order: str, value: Column, name: str, last: int = 0, width: int = 0) -> DataFrame:
    """Adds the sum of ``value`` over a disk's rows up to this one (``last`` 0) or the one before (-1)."""
    dealt = _carried(_dealt(rows.withColumn("_v", value), order, width or WIDTH), key, F.sum("_v"), F.sum)
    within = F.sum("_v").over(Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, last))
    total = F.coalesce(within, F.lit(0)) + F.coalesce("_carried", F.lit(0))
    return dealt.withColumn(name, total.cast("long")).drop("_v", "_b", "_carried")


def running_start(rows: DataFrame, key: str, order: str, length: str = "length") -> DataFrame:
    """Adds ``start``, the lengths of the rows before."""
    return running(rows, key, order, F.col(length), "start", -1)


def clip(extents: DataFrame, ranges: DataFrame, key: str = "disk_id") -> DataFrame:
    """The parts of extents in each disk's asked range (from_, to_), empty parts dropped."""
    both = extents.join(ranges, key)
    lo, hi = F.greatest("start", "from_"), F.least(end_of(), F.col("to_"))
    return both.where(lo < hi).select(key, lo.alias("start"), (hi - lo).alias("length"), "kind")


def check_bounds(ranges: DataFrame) -> DataFrame:
    """Adds ``issue``: overflow, out_of_bounds or null, for (start, length, size)."""
    end = F.try_add("start", "length")
    issue = F.when(end.isNull(), "overflow").when(end > F.col("size"), "out_of_bounds")
    return ranges.withColumn("issue", issue)


def coalesce_kind(extents: DataFrame, key: str = "disk_id") -> DataFrame:
    """Adjacent rows of one kind as one row, with the number of rows in it."""
    rows = preceded(extents, key, ["start"], ["start", "length", "kind"])
    follows = (F.col("kind") == F.col("_before.kind")) & (F.col("_before.start") + F.col("_before.length") == F.col("start"))
    runs = running(rows, key, "start", (~F.coalesce(follows, F.lit(False))).cast("long"), "_run")
    return runs.groupBy(key, "_run", "kind").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.count("*").alias("n_extents")).drop("_run")


def coalesce_physical(runs: DataFrame, key: str = "disk_id") -> DataFrame:
    """Data runs merge if the backing is the same and the physical places follow on; zero runs always merge.

    Rows: start, length, backing (null: zero) and physical start.
    """
    rows = preceded(runs, key, ["start"], ["start", "length", "backing", "physical"])
    before = {c: F.col(f"_before.{c}") for c in ("start", "length", "backing", "physical")}
    follows = before["start"] + before["length"] == F.col("start")
    both_zero = F.col("backing").isNull() & before["backing"].isNull()
    same = (F.col("backing") == before["backing"]) & (before["physical"] + before["length"] == F.col("physical"))
    new = ~F.coalesce(follows & (both_zero | same), F.lit(False))
    marked = running(rows, key, "start", new.cast("long"), "_run")
    return marked.groupBy(key, "_run", "backing").agg(
        F.min("start").alias("start"), F.sum("length").alias("length"), F.min("physical").alias("physical"), F.count("*").alias("n_runs")
    ).drop("_run")


def fill_gaps(extents: DataFrame, sizes: DataFrame, key: str = "disk_id") -> DataFrame:
    """The extents and zero extents for what lies between them, before the first and after the last."""
    rows = extents.select(key, "start", "length", "kind").unionByName(sizes.select(key, F.col("size").alias("start"), F.lit(0).cast("long").alias("length"), F.lit("end").alias("kind")))
    rows = preceded(rows, key, ["start"], ["start", "length"])
    prev = F.coalesce(F.col("_before.start") + F.col("_before.length"), F.lit(0).cast("long"))
    gaps = rows.select(key, prev.alias("start"), (F.col("start") - prev).alias("length"), F.lit("zero").alias("kind")).where("length > 0")
    return extents.select(key, "start", "length", "kind").unionByName(gaps)


def map_violations(extents: DataFrame, sizes: DataFrame, key: str = "disk_id") -> DataFrame:
    """(disk, check, position) for maps that don't tile their disk: empty, gap, overlap, beyond and short."""
    prev = F.coalesce(F.col("_before.start") + F.col("_before.length"), F.lit(0).cast("long"))
    rows = preceded(extents, key, ["start", "length"], ["start", "length"]).join(sizes.select(key, "size"), key).withColumn("_prev", prev)
    found = F.array(
        F.when(F.col("length") == 0, "empty"), F.when(F.col("start") > F.col("_prev"), "gap"), F.when(F.col("start") < F.col("_prev"), "overlap"), F.when(end_of() > F.col("size"), "beyond")
    )
    inner = rows.select(key, F.explode(F.array_compact(found)).alias("check"), F.col("start").alias("position"))
    last = extents.groupBy(key).agg(F.max(end_of()).alias("_last"))
    tail = sizes.select(key, "size").join(last, key, "left").where(F.coalesce("_last", F.lit(0)) < F.col("size"))
    return inner.unionByName(tail.select(key, F.lit("short").alias("check"), F.coalesce("_last", F.lit(0).cast("long")).alias("position")))


def split(extents: DataFrame, block: int, key: str = "disk_id") -> DataFrame:
    """Work items of at most ``block`` bytes, in order within an extent."""
    some = extents.where("length > 0")
    at = F.explode(F.sequence(F.col("start"), end_of() - 1, F.lit(block).cast("long"))).alias("_at")
    items = some.select(key, "kind", end_of().alias("_end"), at)
    return items.select(key, F.col("_at").alias("start"), F.least(F.lit(block).cast("long"), F.col("_end") - F.col("_at")).alias("length"), "kind")


def interval_join(left: DataFrame, right: DataFrame, width: int, keys: Sequence[str] = ("disk_id",)) -> DataFrame:
    """Pairs of rows whose [start, start + length) and [lo, hi) overlap.

    Both sides are dealt to buckets of ``width`` and joined on them, an equi-join that shuffles by key and bucket, so a
    large disk is spread; a pair is kept in its first common bucket only.  Pick a width near the longer side's length.
    """
    a = left.where("length > 0").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((end_of() - 1) / width))))
    b = right.where("lo < hi").withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    both = a.join(b, [*keys, "_b"]).where((F.col("start") < F.col("hi")) & (F.col("lo") < end_of()))
    return both.where(F.col("_b") == F.floor(F.greatest("start", "lo") / width)).drop("_b")


def point_lookup(points: DataFrame, extents: DataFrame, key: str = "disk_id") -> DataFrame:
    """The extent that holds each point (key, point), by one sort: points and extents in one order, the last extent
    start carried forward.  Points outside every extent have nulls."""
    marks = extents.select(key, F.col("start").alias("_at"), F.lit(0).alias("_side"), F.struct("start", "length", "kind").alias("_e"), F.lit(None).cast("long").alias("point"))
    asked = points.select(key, F.col("point").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("struct<start:bigint,length:bigint,kind:string>").alias("_e"), "point")
    dealt = _carried(_dealt(marks.unionByName(asked), "_at", WIDTH), key, F.max_by("_e", F.when(F.col("_side") == 0, F.col("_at"))), lambda x: F.last(x, ignorenulls=True))
    w = Window.partitionBy(key, "_b").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("_e", F.coalesce(F.last("_e", ignorenulls=True).over(w), F.col("_carried"))).where("_side = 1")
    inside = F.col("point") < F.col("_e.start") + F.col("_e.length")
    return found.select(key, "point", *[F.when(inside, F.col(f"_e.{c}")).alias(c) for c in ("start", "length", "kind")])


def unaligned(ranges: DataFrame, step: int) -> DataFrame:
    """Ranges whose start or length is not a multiple of ``step``."""
    return ranges.where(~(is_multiple(F.col("start"), step) & is_multiple(F.col("length"), step)))


def overlapping_regions(regions: DataFrame, key: str = "disk_id") -> DataFrame:
    """Regions that the furthest end before them reaches into."""
    dealt = _carried(_dealt(regions.withColumn("_end", end_of()), "start", WIDTH), key, F.max("_end"), F.max)
    w = Window.partitionBy(key, "_b").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.max("_end").over(w), F.col("_carried"))
    return dealt.withColumn("reached", reached).drop("_end", "_b", "_carried").where("reached > start")
