"""Domain tables derived from the driver's tables, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators import ranges


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def extents(spark: SparkSession, sf: str) -> DataFrame:
    """disk_id, seq, start, length, kind: a gap-free map for each customer."""
    kind = F.when(F.col("o_orderstatus") == "F", "data").when(F.col("o_orderstatus") == "O", "zero").otherwise("hole")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("disk_id"), F.col("o_orderkey").alias("seq"), (512 * (1 + F.col("o_orderkey") % 97)).alias("length"), kind.alias("kind"))
    return ranges.running_start(rows, "disk_id", "seq").select("disk_id", "seq", "start", "length", "kind")


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    return extents(spark, sf).groupBy("disk_id").agg(F.sum("length").cast("long").alias("size"))


def broken(spark: SparkSession, sf: str) -> DataFrame:
    """Maps with extents missing (a gap), moved back (an overlap) or empty."""
    e = extents(spark, sf).where("seq % 101 <> 0")
    return e.withColumn("start", F.when(F.col("seq") % 103 == 0, F.col("start") - 512).otherwise(F.col("start"))).withColumn("length", F.when(F.col("seq") % 211 == 0, 0).otherwise(F.col("length")).cast("long"))


def grains(spark: SparkSession, sf: str) -> DataFrame:
    """disk_id, layer, grain, sector: allocated grains of layered images with equal grain sizes."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("disk_id"), (F.col("l_linenumber") % 4).alias("layer"), (F.col("l_partkey") % 256).alias("grain"))
    return rows.agg(F.min("l_orderkey").alias("sector"))


def mixed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """disk_id, layer, start, length, backing_start: layers with grain sizes of 4, 8 and 12 KiB."""
    layer = F.col("l_linenumber") % 3
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("disk_id"), layer.alias("layer"), (F.col("l_partkey") % 48).alias("g"), "l_orderkey")
    size = (F.col("layer") + 1).cast("long") * 4096
    return rows.groupBy("disk_id", "layer", "g").agg((F.min("l_orderkey") * 512).alias("backing_start")).select("disk_id", "layer", (F.col("g") * size).alias("start"), size.alias("length"), "backing_start")


def mixed_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return mixed_runs(spark, sf).select("disk_id").distinct().withColumn("size", F.lit(48 * 12288 + 4096).cast("long"))


def accesses(spark: SparkSession, sf: str) -> DataFrame:
    """req_id, file_id, start, length, writes, direct, flush: requests of each user's file."""
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("req_id"),
        F.col("user_id").alias("file_id"),
        F.floor(F.col("value") * 100).alias("start"),
        F.when(F.col("event_id") % 17 == 0, 0).otherwise(40 + F.col("event_id") % 4000).cast("long").alias("length"),
        kind.isin("click", "purchase").alias("writes"),
        kind.isin("purchase", "view").alias("direct"),
        ((kind == "error") & (F.col("event_id") % 50 == 0)).alias("flush"),
        "ts",
    )


STATE_OF = {"click": "lease_held", "error": "abort_intent", "purchase": "transfer_complete", "signup": "prepared", "view": "complete_intent"}


def journal(spark: SparkSession, sf: str) -> DataFrame:
    """artifact, sequence, state, ts, has_stage, has_lease: events of a user as the entries of a job."""
    from pyspark.sql import Window

    states = F.create_map(*[F.lit(x) for p in STATE_OF.items() for x in p])
    e = table(spark, sf, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1
    return e.select(
        F.col("user_id").alias("artifact"), n.cast("long").alias("sequence"), states[F.col("event_type")].alias("state"), "ts", (F.col("event_id") % 3 != 0).alias("has_stage"), (F.col("event_id") % 2 == 0).alias("has_lease")
    )


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """bench, variant, pair, value."""
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("bench"), F.col("l_linestatus").alias("variant"), (F.col("l_suppkey") % 5).alias("pair"), F.col("l_extendedprice").alias("value"), "l_quantity", "l_orderkey")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """parent, child: root, regions, nations, and their customers and suppliers."""
    r = table(spark, sf, "region").select(F.lit("root").alias("parent"), F.concat(F.lit("r"), "r_regionkey").alias("child"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.concat(F.lit("s"), "s_suppkey").alias("child"))
    return r.unionByName(n).unionByName(c).unionByName(s)


#: The same tables as common table expressions for DuckDB.
SQL = {
    "extents": """extents AS (SELECT o_custkey AS disk_id, o_orderkey AS seq,
        CAST(coalesce(sum(512 * (1 + o_orderkey % 97)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
        CAST(512 * (1 + o_orderkey % 97) AS BIGINT) AS length, CASE o_orderstatus WHEN 'F' THEN 'data' WHEN 'O' THEN 'zero' ELSE 'hole' END AS kind FROM orders),
        sizes AS (SELECT disk_id, CAST(sum(length) AS BIGINT) AS size FROM extents GROUP BY disk_id)""",
    "broken": """broken AS (SELECT disk_id, seq, CASE WHEN seq % 103 = 0 THEN start - 512 ELSE start END AS start, CASE WHEN seq % 211 = 0 THEN 0 ELSE length END AS length, kind
        FROM extents WHERE seq % 101 <> 0)""",
    "grains": """grains AS (SELECT l_suppkey AS disk_id, l_linenumber % 4 AS layer, l_partkey % 256 AS grain, min(l_orderkey) AS sector FROM lineitem GROUP BY ALL)""",
    "mixed": """mixed AS (SELECT disk_id, layer, g * (layer + 1) * 4096 AS start, CAST((layer + 1) * 4096 AS BIGINT) AS length, o * 512 AS backing_start FROM
        (SELECT l_suppkey AS disk_id, l_linenumber % 3 AS layer, l_partkey % 48 AS g, min(l_orderkey) AS o FROM lineitem GROUP BY ALL))""",
    "accesses": """accesses AS (SELECT event_id AS req_id, user_id AS file_id, CAST(floor(value * 100) AS BIGINT) AS start, CASE WHEN event_id % 17 = 0 THEN 0 ELSE 40 + event_id % 4000 END AS length,
        event_type IN ('click', 'purchase') AS writes, event_type IN ('purchase', 'view') AS direct, event_type = 'error' AND event_id % 50 = 0 AS flush, ts FROM events)""",
    "journal": """journal AS (SELECT user_id AS artifact, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS sequence,
        CASE event_type WHEN 'click' THEN 'lease_held' WHEN 'error' THEN 'abort_intent' WHEN 'purchase' THEN 'transfer_complete' WHEN 'signup' THEN 'prepared' ELSE 'complete_intent' END AS state,
        ts, event_id % 3 <> 0 AS has_stage, event_id % 2 = 0 AS has_lease FROM events)""",
    "samples": """samples AS (SELECT l_returnflag AS bench, l_linestatus AS variant, l_suppkey % 5 AS pair, l_extendedprice AS value, l_quantity, l_orderkey FROM lineitem)""",
    "edges": """edges AS (SELECT 'root' AS parent, 'r' || r_regionkey AS child FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
        UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)""",
}


def with_(names: str, query: str) -> str:
    """The query under the named tables."""
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names.split()) + " " + query
