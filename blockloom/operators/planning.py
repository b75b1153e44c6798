"""Copy plans: summaries, operations, work, memory, and whether a plan still holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.binary import has_all, is_multiple, is_power_of_two
from blockloom.functions.fingerprint import KIND_CODE, extent_fingerprint

# The capability bits in order.
CAPABILITIES = {name: 1 << i for i, name in enumerate(("read", "write", "flush", "discard", "write_zero", "extents", "sparse", "direct_io", "discard_zeroes"))}


def summary(extents: DataFrame, key: str = "disk_id") -> DataFrame:
    """Bytes by kind, all bytes and the number of extents of each disk."""
    by_kind = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("length"))), F.lit(0)).cast("long").alias(f"{k}_bytes") for k in ("data", "zero", "hole")]
    return extents.groupBy(key).agg(*by_kind, F.sum("length").cast("long").alias("logical_bytes"), F.count("*").alias("extent_count"))


def fingerprints(extents: DataFrame, key: str = "disk_id") -> DataFrame:
    """The order-sensitive fingerprint of each disk's map.  A map is folded where its rows are: it must be in one row."""
    code = F.create_map(*[F.lit(x) for pair in KIND_CODE.items() for x in pair])[F.col("kind")].cast("long")
    rows = F.array_sort(F.collect_list(F.struct("start", "length", code.alias("code"))))
    return extents.groupBy(key).agg(rows.alias("_rows")).select(key, extent_fingerprint(F.col("_rows")).alias("fingerprint"))


def operation(kind: Column, caps: Column) -> Column:
    """What is done for an extent: copy, discard, zero, or zeros written out.  A hole may be discarded only where
    discarded blocks read as zero."""
    zero = F.when(has_all(caps, CAPABILITIES["write_zero"]), "zero").otherwise("write_zeros")
    discard = has_all(caps, CAPABILITIES["discard"] | CAPABILITIES["discard_zeroes"])
    return F.when(kind == "data", "copy").when((kind == "hole") & discard, "discard").otherwise(zero)


def work_kind(kind: Column) -> Column:
    return F.when(kind == "data", "copy").when(kind == "zero", "zero").when(kind == "hole", "discard")


def threaded_memory(buffers: Column, block: Column, workers: Column, queue: Column, resident: Column, buffer_cost: int, item_cost: int, stats_cost: int) -> Column:
    """Bytes that a threaded copy needs: resident extents, buffers, and a queue if there is more than one worker."""
    waiting = F.when(workers > 1, (queue + workers + 1) * item_cost + workers * stats_cost).otherwise(F.lit(0))
    return (resident + buffers * (block + buffer_cost) + waiting).cast("long")


def over_memory(needs: DataFrame) -> DataFrame:
    """Rows whose ``required`` is above their ``budget``; a null budget is none."""
    return needs.where("budget is not null and required > budget")


def throughput(total: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, total / seconds).otherwise(F.lit(0.0))


def select_backend(requested: Column, compatible: Column, issue: Column) -> Column:
    """(selected, reason): the planning decision for threaded, native and auto requests; selected is null if the request
    cannot be met."""

    def of(selected: str | None, reason: str) -> Column:
        return F.struct(F.lit(selected).cast("string").alias("selected"), F.lit(reason).alias("reason"))

    return (
        F.when(requested == "threaded", of("threaded", "requested_threaded"))
        .when((requested == "native") & issue.isNotNull(), of(None, "requests_incompatible"))
        .when((requested == "auto") & issue.isNotNull(), of("threaded", "requests_incompatible"))
        .when((requested == "native") & compatible, of("native", "requested_native"))
        .when(requested == "native", of(None, "native_unsupported"))
        .when(compatible, of("native", "descriptors_compatible"))
        .otherwise(of("threaded", "descriptors_incompatible"))
    )


def request_issues(plans: DataFrame, ranges: DataFrame) -> DataFrame:
    """The first rule that a plan breaks, or null: plan_id, issue.

    ``plans``: plan_id, start, length, block, source and destination alignments (src_align, dst_align) and whether each
    is direct (src_direct, dst_direct), and the alignment of buffers (buffer_align).  ``ranges``: plan_id, range_no,
    start, length of data.  Rules in order: block size, end beyond the signed range, alignments that are no powers of
    two, a buffer that cannot be laid out (the widest alignment is no power of two, or the block rounded up to it passes
    the signed range), then for each data range and direct endpoint the range's alignment and, if it is split, the
    block's.
    """
    widest = F.greatest("src_align", "dst_align", "buffer_align")
    first = (
        F.when((F.col("block") <= 0) | (F.col("block") > 0xFFFFFFFF), "block_size")
        .when(F.try_add("start", "length").isNull(), "range")
        .when(~is_power_of_two(F.col("src_align")), "source_alignment")
        .when(~is_power_of_two(F.col("dst_align")), "destination_alignment")
        .when(~is_power_of_two(widest) | (F.col("block") > F.lit((1 << 63) - 1) - (widest - 1)), "buffer_layout")
    )
    per_plan = plans.withColumn("_first", first)
    ends = F.explode(
        F.array(
            F.struct(F.lit(0).alias("n"), F.lit("source").alias("end"), F.col("src_direct").alias("direct"), F.col("src_align").alias("align")),
            F.struct(F.lit(1).alias("n"), F.lit("destination").alias("end"), F.col("dst_direct").alias("direct"), F.col("dst_align").alias("align")),
        )
    )
    r = ranges.select("plan_id", "range_no", F.col("start").alias("r_start"), F.col("length").alias("r_length"))
    each = per_plan.where("_first is null").select("plan_id", "block", ends.alias("e")).where("e.direct").join(r, "plan_id")
    aligned = is_multiple(F.col("r_start"), F.col("e.align")) & is_multiple(F.col("r_length"), F.col("e.align"))
    rule = F.when(~aligned, "range").when((F.col("r_length") > F.col("block")) & ~is_multiple(F.col("block"), F.col("e.align")), "block")
    broken = each.withColumn("_rule", rule).where("_rule is not null")
    broken = broken.groupBy("plan_id").agg(F.min_by(F.concat_ws("_", "e.end", "_rule"), F.struct("range_no", "e.n")).alias("_range"))
    return per_plan.join(broken, "plan_id", "left").select("plan_id", F.coalesce("_first", "_range").alias("issue"))


def preflight(pairs: DataFrame) -> DataFrame:
    """Violations (pair_id, check) of copy pairs.

    A pair: source and destination capabilities (src_caps, dst_caps), sizes, identities (null: unknown, which proves
    nothing), range (start, length) and whether it flushes.
    """
    end = F.try_add("start", "length")
    both_known = F.col("src_identity").isNotNull() & F.col("dst_identity").isNotNull()
    checks = [
        ("source read", ~has_all(F.col("src_caps"), CAPABILITIES["read"])),
        ("source bounds", end.isNull() | (end > F.col("src_size"))),
        ("destination write", ~has_all(F.col("dst_caps"), CAPABILITIES["write"])),
        ("destination flush", F.col("flush") & ~has_all(F.col("dst_caps"), CAPABILITIES["flush"])),
        ("destination bounds", end.isNull() | (end > F.col("dst_size"))),
        ("alias", both_known & (F.col("src_identity") == F.col("dst_identity"))),
    ]
    return violations(pairs, ["pair_id"], checks)


def stale_plans(plans: DataFrame) -> DataFrame:
    """Violations (plan_id, check) of a plan (plan_*) against what is there now (now_*)."""
    checks = [
        ("source size", F.col("plan_bytes") != F.col("now_source_bytes")),
        ("destination size", F.col("plan_bytes") > F.col("now_destination_bytes")),
        ("block size", F.col("plan_block") != F.col("now_block")),
        ("alignment", F.col("plan_alignment") != F.col("now_alignment")),
        ("fingerprint", F.col("plan_fingerprint") != F.col("now_fingerprint")),
    ]
    return violations(plans, ["plan_id"], checks)


def violations(rows: DataFrame, keys: list[str], checks: list[tuple[str, Column]]) -> DataFrame:
    """A row (keys, check) for each named condition that holds."""
    named = F.array_compact(F.array(*[F.when(broken, name) for name, broken in checks]))
    return rows.select(*keys, F.explode(named).alias("check"))
