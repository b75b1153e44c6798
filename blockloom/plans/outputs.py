"""Queries over output journals, their records, a connection's requests and downloaded payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.operators import journal, verify
from blockloom.plans import fixtures as X
from blockloom.plans.registry import query

_NAMES = ", ".join(f"'{s}'" for s in journal.OUTPUT_SEQUENCES)
_CLEANABLE = ", ".join(f"'{s}'" for s in journal.OUTPUT_CLEANABLE)


@query(f"""WITH r AS (SELECT user_id AS output, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
    j AS (SELECT output, i AS sequence, CASE WHEN event_id % 7 = 0 THEN 'cleanup_intent' WHEN event_id % 13 = 0 THEN 'cleaned' ELSE [{_NAMES}][CAST(i % 9 + 1 AS INTEGER)] END AS state FROM r),
    m AS (SELECT *, lag(state) OVER (PARTITION BY output ORDER BY sequence) AS before FROM j), n AS (SELECT *, list_position([{_NAMES}], state) AS s, list_position([{_NAMES}], before) AS b FROM m WHERE before IS NOT NULL)
    SELECT output, sequence, before, state FROM n WHERE NOT (coalesce(s = b + 1, false) OR (state = 'cleanup_intent' AND before IN ({_CLEANABLE})) OR (before = 'cleanup_intent' AND state = 'cleaned'))""")
def output_steps(spark: SparkSession, sf: str) -> DataFrame:
    e, i = F.col("event_id"), F.col("sequence")
    rows = X.table(spark, sf, "events").select(F.col("user_id").alias("output"), "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("sequence"))
    state = F.when(e % 7 == 0, "cleanup_intent").when(e % 13 == 0, "cleaned").otherwise(F.element_at(F.array(*map(F.lit, journal.OUTPUT_SEQUENCES)), (i % 9 + 1).cast("int")))
    return journal.illegal_steps(rows.select("output", "sequence", state.alias("state")), "output", "sequence", journal.output_steps()).select("output", "sequence", "before", "state")


@query("""SELECT event_id AS key, CASE WHEN event_id % 3 = 0 THEN 'checksum' WHEN event_id % 5 = 0 THEN 'unasked' WHEN event_id % 7 = 0 THEN 'artifact' WHEN event_id % 11 = 0 THEN 'store' WHEN event_id % 13 = 0 THEN 'source' WHEN event_id % 17 = 0 THEN 'logical_bytes'
    WHEN event_id % 19 = 0 THEN 'operation' END AS issue FROM events""")
def output_bindings(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    rows = X.table(spark, sf, "events").select(e.alias("key"), F.col("user_id").alias("artifact"), F.lit("s").alias("store"), F.col("event_type").alias("source"), (e * 512).alias("logical_bytes"))
    k = F.col("key")
    told = rows.select(
        "key", F.when(k % 7 == 0, F.col("artifact") + 1).otherwise(F.col("artifact")).alias("artifact"), F.when(k % 11 != 0, F.col("store")).alias("store"), F.when(k % 13 == 0, "x").otherwise(F.col("source")).alias("source"),
        F.when(k % 17 == 0, 0).otherwise(F.col("logical_bytes")).alias("logical_bytes"), F.when(k % 19 == 0, "00").otherwise("0a").alias("operation"), (k % 3 > 0).alias("intact"),
    )
    return journal.binding_issues(told, rows.where("key % 5 > 0"), "key", ["artifact", "store", "source", "logical_bytes"])


@query("""WITH r AS (SELECT user_id AS connection, event_id AS request, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT connection, request FROM r WHERE n > 8 AND event_type NOT IN ('click', 'error')""")
def refused_requests(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_type")
    method = F.when(k == "click", "Logout").when(k == "error", "HttpNfcLeaseAbort").otherwise("RetrievePropertiesEx")
    rows = X.table(spark, sf, "events").select(F.col("user_id").alias("connection"), F.col("event_id").alias("request"), method.alias("method"))
    return journal.refused_requests(rows, "connection", "request", most=8).select("connection", "request")


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'KDMV' ELSE '' END || coalesce(text, '') AS t FROM documents) SELECT doc_id, CASE WHEN octet_length(encode(t)) < 512 THEN 'short' WHEN NOT starts_with(t, 'KDMV') THEN 'magic' END AS issue FROM p""")
def payload_headers(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.concat(F.when(F.col("doc_id") % 3 == 0, "KDMV").otherwise(""), F.coalesce("text", F.lit("")))
    return X.table(spark, sf, "documents").select("doc_id", verify.payload_issue(payload).alias("issue"))
