"""Paired benchmark statistics: medians, changes, spreads, quartiles, and the checks before them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.binary import close, finite_positive, strict_hex
from blockloom.operators.planning import violations


def run_medians(runs: DataFrame) -> DataFrame:
    """Adds ``recomputed``, the median of time / iterations, and whether it agrees with the recorded median."""
    per = F.transform(F.arrays_zip("times", "iters"), lambda x: x["times"] / x["iters"])
    ordered = F.array_sort(per)
    n = F.size(ordered)
    mid = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    return runs.withColumn("recomputed", mid).withColumn("agrees", close(F.col("recomputed"), F.col("median")))


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.median(value).alias("median"), F.count(value).alias("n"))


def paired_change(rows: DataFrame, case: str, pair: str, variant: str, value: str, baseline: str, candidate: str) -> DataFrame:
    """Per case and pair: both medians and the change in per cent; a side that is missing is null and named."""
    m = medians(rows, [case, pair, variant], value)
    b = m.where(F.col(variant) == baseline).select(case, pair, F.col("median").alias("baseline"))
    c = m.where(F.col(variant) == candidate).select(case, pair, F.col("median").alias("candidate"))
    both = b.join(c, [case, pair], "full_outer")
    issue = F.when(F.col("baseline").isNull(), "no baseline").when(F.col("candidate").isNull(), "no candidate")
    return both.withColumn("change_percent", 100 * (F.col("candidate") / F.col("baseline") - 1)).withColumn("issue", issue)


def change(pairs: DataFrame, case: str) -> DataFrame:
    """Per case: medians of the pairs' medians, their change, the spreads, and whether something calls for a look."""
    spread = {c: F.when(F.min(c) == 0, None).otherwise(100 * (F.max(c) / F.min(c) - 1)) for c in ("baseline", "candidate")}
    out = pairs.groupBy(case).agg(
        F.median("baseline").alias("baseline"),
        F.median("candidate").alias("candidate"),
        spread["baseline"].alias("baseline_spread"),
        spread["candidate"].alias("candidate_spread"),
        F.count("*").alias("pairs"),
    )
    out = out.withColumn("change_percent", 100 * (F.col("candidate") / F.col("baseline") - 1))
    return out.withColumn("look", (F.col("change_percent") > 5) | (F.col("baseline_spread") > 5) | (F.col("candidate_spread") > 5))


def quartiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles and how many values lie beyond one and a half times their range."""
    q = rows.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    q = q.select(*keys, *[F.col("_q")[i].alias(f"q{i + 1}") for i in range(3)])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    beyond = (F.col(value) < F.col("q1") - reach) | (F.col(value) > F.col("q3") + reach)
    return rows.join(q, keys).groupBy(*keys, "q1", "q2", "q3").agg(F.sum(beyond.cast("long")).alias("outliers"))


def completeness(rows: DataFrame, keys: list[str], tag: str, expected: int) -> DataFrame:
    """Groups without exactly the expected number of rows, or with a tag twice."""
    got = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(tag).alias("n_tags"))
    return got.where((F.col("n") != expected) | (F.col("n_tags") != F.col("n")))


def residual(rows: DataFrame, key: str, region: str, value: str, whole: str) -> DataFrame:
    """Mean of the whole less the means of its disjoint regions."""
    means = rows.groupBy(key, region).agg(F.avg(value).alias("_m"))
    is_whole = F.col(region) == whole
    return means.groupBy(key).agg(
        F.max(F.when(is_whole, F.col("_m"))).alias("whole"), F.sum(F.when(~is_whole, F.col("_m"))).alias("parts"), (F.max(F.when(is_whole, F.col("_m"))) - F.sum(F.when(~is_whole, F.col("_m")))).alias("residual")
    )


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side."""
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def extremes(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """First and last value of a key by an order, with the extremes of the order."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.min(order).alias("from_"), F.max(order).alias("to_"), F.max(value).alias("peak"))


def paired_deltas(rows: DataFrame, keys: list[str], variant: str, value: str, baseline: str, candidate: str) -> DataFrame:
    """Candidate less baseline, and in per cent, where a group has exactly one row of each; other groups are named."""
    sides = [F.collect_list(F.when(F.col(variant) == v, F.col(value))) for v in (baseline, candidate)]
    got = rows.groupBy(*keys).agg(sides[0].alias("_b"), sides[1].alias("_c"))
    one = (F.size("_b") == 1) & (F.size("_c") == 1)
    b, c = F.get("_b", F.lit(0)), F.get("_c", F.lit(0))
    return got.select(*keys, F.when(one, c - b).alias("delta"), F.when(one, 100 * (c / b - 1)).alias("delta_percent"), F.when(~one, "not paired").alias("issue"))


def phase_sums(events: DataFrame, key: str, order: str, at: str, tolerance: float = 1e-6) -> DataFrame:
    """Per key: the sum of the steps between its events, last less first, and whether steps are never negative."""
    from pyspark.sql import Window

    step = F.col(at) - F.lag(at).over(Window.partitionBy(key).orderBy(order))
    got = events.withColumn("_step", step).groupBy(key).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("steps"), (F.max_by(at, order) - F.min_by(at, order)).alias("whole"), F.coalesce(F.min("_step") >= 0, F.lit(True)).alias("monotone"))
    return got.withColumn("consistent", F.abs(F.col("steps") - F.col("whole")) <= tolerance)


def exact_medians(rows: DataFrame, key: str, value: str, runs: int = 3) -> DataFrame:
    """Medians of keys with exactly so many runs."""
    return rows.groupBy(key).agg(F.median(value).alias("median"), F.count("*").alias("n")).where(F.col("n") == runs).drop("n")


def broken_alternation(rows: DataFrame, pair: str, order: str, backend: str, first: str, second: str) -> DataFrame:
    """Runs whose backend is not the one that their pair's parity and their place call for."""
    from pyspark.sql import Window

    place = (F.row_number().over(Window.partitionBy(pair).orderBy(order)) - 1) % 2
    expected = F.when((F.col(pair) + place) % 2 == 0, first).otherwise(second)
    return rows.withColumn("expected", expected).where(F.col(backend) != F.col("expected"))


def evidence_violations(rows: DataFrame, keys: list[str], pairs: int, backends: list[str]) -> DataFrame:
    """(keys, check) for every field of a measured digest that cannot be right: pair, backend, sizes, pattern, digest,
    oracle, and times and memory that are not finite and positive."""
    c = F.col
    checks = [
        ("pair", (c("pair") < 0) | (c("pair") >= pairs)),
        ("backend", ~c("backend").isin(*backends)),
        ("bytes", c("n_bytes") != c("expected_bytes")),
        ("chunk", c("chunk") != c("expected_chunk")),
        ("iterations", (c("iterations") <= 0) | (c("iterations") != c("expected_iterations"))),
        ("pattern", c("sparse") != c("expected_sparse")),
        ("digest", ~strict_hex(c("sha256"), 32) | (c("sha256") != c("expected_sha256"))),
        ("oracle", ~c("oracle_passed")),
        *[(x, ~finite_positive(c(x).cast("double"))) for x in ("wall_ms", "cpu_ms", "peak_rss_kib")],
    ]
    return violations(rows, keys, [(n, F.coalesce(x, F.lit(True))) for n, x in checks])


def normalised_medians(rows: DataFrame, case: str, run: str, backend: str, stage: str, value: str, iterations: str, baseline: str, candidate: str) -> DataFrame:
    """(case, baseline, candidate, change_percent): per repeated run (stage ``repeat``) the median of value / iterations,
    of these the median, and the candidate's change."""
    per = rows.where(F.col(stage) == "repeat").withColumn("_per", F.col(value) / F.col(iterations))
    rounds = per.groupBy(case, run, backend).agg(F.median("_per").alias("_round"))
    side = lambda b: F.median(F.when(F.col(backend) == b, F.col("_round")))
    got = rounds.groupBy(case).agg(side(baseline).alias("baseline"), side(candidate).alias("candidate"))
    return got.withColumn("change_percent", 100 * (F.col("candidate") / F.col("baseline") - 1))
