"""Queries over benchmark samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators import statistics as S
from blockloom.plans import fixtures as X
from blockloom.plans.fixtures import with_
from blockloom.plans.registry import query

_PAIRS = """, m AS (SELECT bench, pair, variant, median(value) AS v FROM samples GROUP BY ALL), p AS (SELECT coalesce(b.bench, c.bench) AS bench, coalesce(b.pair, c.pair) AS pair, b.v AS baseline, c.v AS candidate
    FROM (SELECT * FROM m WHERE variant = 'F') b FULL JOIN (SELECT * FROM m WHERE variant = 'O') c ON b.bench = c.bench AND b.pair = c.pair) """


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return S.paired_change(X.samples(spark, sf), "bench", "pair", "variant", "value", "F", "O")


@query(with_("samples", _PAIRS + """SELECT bench, pair, round(baseline, 6) AS baseline, round(candidate, 6) AS candidate, round(100 * (candidate / baseline - 1), 6) AS change_percent, CASE WHEN baseline IS NULL THEN 'no baseline' WHEN candidate IS NULL THEN 'no candidate' END AS issue FROM p"""))
def paired_medians(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("bench", "pair", *[F.round(c, 6).alias(c) for c in ("baseline", "candidate", "change_percent")], "issue")


@query(with_("samples", _PAIRS + """, g AS (SELECT bench, median(baseline) AS b, median(candidate) AS c, 100 * (max(baseline) / min(baseline) - 1) AS bs, 100 * (max(candidate) / min(candidate) - 1) AS cs, count(*) AS pairs FROM p GROUP BY bench)
    SELECT bench, round(b, 6) AS baseline, round(c, 6) AS candidate, round(bs, 6) AS baseline_spread, round(cs, 6) AS candidate_spread, pairs, round(100 * (c / b - 1), 6) AS change_percent, 100 * (c / b - 1) > 5 OR bs > 5 OR cs > 5 AS look FROM g"""))
def paired_change(spark: SparkSession, sf: str) -> DataFrame:
    out = S.change(_pairs(spark, sf), "bench")
    return out.select("bench", *[F.round(c, 6).alias(c) for c in ("baseline", "candidate", "baseline_spread", "candidate_spread")], "pairs", F.round("change_percent", 6).alias("change_percent"), "look")


@query(with_("samples", """, q AS (SELECT bench, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM samples GROUP BY bench)
    SELECT bench, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, CAST(sum(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS outliers FROM samples JOIN q USING (bench) GROUP BY ALL"""))
def quartiles(spark: SparkSession, sf: str) -> DataFrame:
    out = S.quartiles(X.samples(spark, sf), ["bench"], "value")
    return out.select("bench", *[F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")], "outliers")


@query(with_("samples", """SELECT bench, variant, round(median(l_quantity), 6) AS median, count(l_quantity) AS n FROM samples GROUP BY ALL"""))
def mode_medians(spark: SparkSession, sf: str) -> DataFrame:
    return S.medians(X.samples(spark, sf), ["bench", "variant"], "l_quantity").withColumn("median", F.round("median", 6))


@query(with_("samples", """, r AS (SELECT bench, pair, l_orderkey % 4 AS round, median(value / l_quantity) AS m FROM samples GROUP BY ALL) SELECT bench, pair, round(median(m), 6) AS median, count(*) AS n FROM r GROUP BY ALL"""))
def two_level_medians(spark: SparkSession, sf: str) -> DataFrame:
    per = X.samples(spark, sf).withColumn("v", F.col("value") / F.col("l_quantity")).withColumn("round", F.col("l_orderkey") % 4)
    inner = S.medians(per, ["bench", "pair", "round"], "v").withColumnRenamed("median", "m").drop("n")
    return S.medians(inner, ["bench", "pair"], "m").withColumn("median", F.round("median", 6))


@query("""WITH r AS (SELECT o_custkey AS run, list(o_totalprice ORDER BY o_orderkey) AS t, list(1 + o_orderkey % 7 ORDER BY o_orderkey) AS i FROM orders GROUP BY o_custkey), m AS (SELECT run, (SELECT median(x / y) FROM (SELECT unnest(t) AS x, unnest(i) AS y)) AS v FROM r)
    SELECT run, round(v, 6) AS recomputed, run % 4 > 0 AS agrees FROM m""")
def run_medians(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = X.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), F.col("o_totalprice").alias("t"), (1 + k % 7).cast("double").alias("i")))).alias("a"))
    runs = rows.select("run", F.col("a.t").alias("times"), F.col("a.i").alias("iters"), F.lit(0.0).alias("median"))
    told = S.run_medians(runs).select("run", "times", "iters", F.when(F.col("run") % 4 > 0, F.col("recomputed")).otherwise(F.col("recomputed") + 1).alias("median"))
    return S.run_medians(told).select("run", F.round("recomputed", 6).alias("recomputed"), "agrees")


@query(with_("samples", """SELECT bench, variant, pair, count(*) AS n, count(DISTINCT l_orderkey) AS n_tags FROM samples GROUP BY ALL HAVING count(*) <> 2000 OR count(DISTINCT l_orderkey) <> count(*)"""))
def evidence_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return S.completeness(X.samples(spark, sf), ["bench", "variant", "pair"], "l_orderkey", 2000)


@query("""WITH m AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL) SELECT user_id, round(max(CASE WHEN event_type = 'view' THEN v END), 6) AS whole, round(sum(CASE WHEN event_type <> 'view' THEN v END), 6) AS parts,
    round(max(CASE WHEN event_type = 'view' THEN v END) - sum(CASE WHEN event_type <> 'view' THEN v END), 6) AS residual FROM m GROUP BY user_id""")
def region_residual(spark: SparkSession, sf: str) -> DataFrame:
    out = S.residual(X.table(spark, sf, "events"), "user_id", "event_type", "value", "view")
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("whole", "parts", "residual")])


@query("""SELECT user_id, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, min(event_id) AS from_, max(event_id) AS to_, max(value) AS peak FROM events GROUP BY user_id""")
def progress_extremes(spark: SparkSession, sf: str) -> DataFrame:
    return S.extremes(X.table(spark, sf, "events"), "user_id", "event_id", "value")


@query("""(SELECT l_partkey AS workload, 'left' AS only_in FROM lineitem WHERE l_linestatus = 'F' EXCEPT SELECT l_partkey, 'left' FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 45)
    UNION ALL (SELECT l_partkey, 'right' FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 45 EXCEPT SELECT l_partkey, 'right' FROM lineitem WHERE l_linestatus = 'F')""")
def workload_sets(spark: SparkSession, sf: str) -> DataFrame:
    l = X.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "workload")
    return S.set_difference(l.where("l_linestatus = 'F'").select("workload").distinct(), l.where("l_returnflag = 'N' and l_quantity > 45").select("workload").distinct())


@query("""SELECT event_type AS method, count(*) AS requests, round(quantile_cont(value, 0.5), 6) AS median_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, CAST(sum(event_id) AS BIGINT) AS response_bytes, count(*) FILTER (event_id % 13 = 0) AS errors FROM events GROUP BY event_type""")
def request_latency(spark: SparkSession, sf: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return X.table(spark, sf, "events").groupBy(F.col("event_type").alias("method")).agg(
        F.count("*").alias("requests"), p(0.5).alias("median_ms"), p(0.95).alias("p95_ms"), F.sum("event_id").alias("response_bytes"), F.count_if(F.col("event_id") % 13 == 0).alias("errors")
    )
