"""Further queries over records, streams and samples."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators import journal, ranges
from blockloom.operators import statistics as S
from blockloom.plans import fixtures as X
from blockloom.plans.fixtures import with_
from blockloom.plans.records import _descriptors
from blockloom.plans.registry import query
from blockloom.sources import descriptors, streams


@query("""WITH r AS (SELECT user_id AS disk_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS record, CASE WHEN event_type = 'error' THEN 'table' ELSE 'grain' END AS kind, CAST(floor(value * 10) AS BIGINT) + 1 AS length, (event_id % 50) * 128 + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS sector FROM events),
    e AS (SELECT *, CASE WHEN kind = 'grain' THEN (length + 12 + 511) // 512 * 512 ELSE 512 + length END AS size FROM r),
    p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY disk_id ORDER BY record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN record % 40 = 39 THEN 512 ELSE 0 END AS start FROM e),
    w AS (SELECT *, lag(start + size) OVER o AS prev, max(CASE WHEN kind = 'grain' THEN sector END) OVER (PARTITION BY disk_id ORDER BY record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lead(record) OVER o IS NULL AS last FROM p WINDOW o AS (PARTITION BY disk_id ORDER BY record))
    SELECT disk_id, record, 'tiling' AS "check" FROM w WHERE prev <> start UNION ALL SELECT disk_id, record, 'duplicate' FROM w WHERE kind = 'grain' AND sector = before UNION ALL SELECT disk_id, record, 'order' FROM w WHERE kind = 'grain' AND sector < before
    UNION ALL SELECT disk_id, record, 'place' FROM w WHERE kind = 'grain' AND sector % 128 <> 0 UNION ALL SELECT disk_id, record, 'no end' FROM w WHERE last""")
def stream_violations(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = X.table(spark, sf, "events").select(
        F.col("user_id").alias("disk_id"), (F.row_number().over(w) - 1).cast("long").alias("record"), F.when(F.col("event_type") == "error", "table").otherwise("grain").alias("kind"), (F.floor(F.col("value") * 10) + 1).alias("length"),
        (F.col("event_id") % 50 * 128 + (F.col("event_id") % 97 == 0).cast("int")).alias("sector"),
    )
    sized = streams.record_ends(e.withColumn("start", F.lit(0).cast("long"))).drop("start").withColumnRenamed("end", "size")
    placed = ranges.running_start(sized, "disk_id", "record", "size").withColumn("start", F.col("start") + F.when(F.col("record") % 40 == 39, 512).otherwise(0))
    return streams.violations(placed.drop("size"))


def stream_file(grains: dict[int, bytes]) -> bytes:
    """A stream image with front padding, the grains in order, and an end marker."""
    out = bytearray(65536)
    struct.pack_into("<Q", out, 64, 128)
    for sector, data in grains.items():
        z = zlib.compress(data)
        out += (struct.pack("<QI", sector, len(z)) + z).ljust(-(-(12 + len(z)) // 512) * 512, b"\0")
    return bytes(out + bytes(512))


@query(with_("grains", """SELECT disk_id * 4 + layer AS disk_id, grain, CASE WHEN grain % 9 > 0 THEN sector END AS first, CASE WHEN grain % 8 > 0 THEN sector + CASE WHEN grain % 7 = 0 THEN 1 ELSE 0 END END AS second FROM grains WHERE (grain % 9 = 0) <> (grain % 8 = 0) OR (grain % 9 > 0 AND grain % 8 > 0 AND grain % 7 = 0)"""))
def redundant_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A table for each layer of each disk, and its copy with grains missing and changed."""
    g = X.grains(spark, sf).withColumn("disk_id", F.col("disk_id") * 4 + F.col("layer"))
    return streams.redundant_tables(g.where("grain % 9 > 0"), g.where("grain % 8 > 0").withColumn("sector", F.col("sector") + (F.col("grain") % 7 == 0).cast("int")))


@query("""SELECT user_id AS disk_id, CAST(coalesce(max(CASE WHEN event_type = 'view' THEN event_id + 12 END), 0) AS BIGINT) AS largest FROM events GROUP BY user_id""")
def largest_record(spark: SparkSession, sf: str) -> DataFrame:
    return streams.largest_record(X.table(spark, sf, "events").select(F.col("user_id").alias("disk_id"), F.when(F.col("event_type") == "view", "grain").otherwise("table").alias("kind"), F.col("event_id").alias("length")))


@query("""SELECT o_custkey AS grp, round(CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 1 AND count(*) FILTER (o_orderstatus = 'O') = 1 THEN max(o_totalprice) FILTER (o_orderstatus = 'O') - max(o_totalprice) FILTER (o_orderstatus = 'F') END, 6) AS delta,
    round(CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 1 AND count(*) FILTER (o_orderstatus = 'O') = 1 THEN 100 * (max(o_totalprice) FILTER (o_orderstatus = 'O') / max(o_totalprice) FILTER (o_orderstatus = 'F') - 1) END, 6) AS delta_percent,
    CASE WHEN NOT (count(*) FILTER (o_orderstatus = 'F') = 1 AND count(*) FILTER (o_orderstatus = 'O') = 1) THEN 'not paired' END AS issue FROM orders GROUP BY o_custkey""")
def paired_deltas(spark: SparkSession, sf: str) -> DataFrame:
    got = S.paired_deltas(X.table(spark, sf, "orders").withColumnRenamed("o_custkey", "grp"), ["grp"], "o_orderstatus", "o_totalprice", "F", "O")
    return got.select("grp", F.round("delta", 6).alias("delta"), F.round("delta_percent", 6).alias("delta_percent"), "issue")


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN user_id % 3 = 0 THEN value ELSE event_id * 0.5 END AS pos FROM events), s AS (SELECT *, pos - lag(pos) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM e)
    SELECT user_id, round(coalesce(sum(step), 0), 4) AS steps, round(arg_max(pos, event_id) - arg_min(pos, event_id), 4) AS whole, coalesce(min(step) >= 0, true) AS monotone, true AS consistent FROM s GROUP BY user_id""")
def phase_sums(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "events").withColumn("pos", F.when(F.col("user_id") % 3 == 0, F.col("value")).otherwise(F.col("event_id") * 0.5))
    got = S.phase_sums(e, "user_id", "event_id", "pos")
    return got.select("user_id", F.round("steps", 4).alias("steps"), F.round("whole", 4).alias("whole"), "monotone", "consistent")


@query("""SELECT o_custkey AS name, round(median(o_totalprice), 6) AS median FROM orders GROUP BY 1 HAVING count(*) = 3""")
def three_run_medians(spark: SparkSession, sf: str) -> DataFrame:
    got = S.exact_medians(X.table(spark, sf, "orders").withColumnRenamed("o_custkey", "name"), "name", "o_totalprice")
    return got.withColumn("median", F.round("median", 6))


@query("""WITH r AS (SELECT user_id AS pair, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'a' ELSE 'b' END AS backend, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 2 AS place FROM events)
    SELECT pair, event_id, backend, CASE WHEN (pair + place) % 2 = 0 THEN 'a' ELSE 'b' END AS expected FROM r WHERE backend <> CASE WHEN (pair + place) % 2 = 0 THEN 'a' ELSE 'b' END""")
def broken_alternation(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "events").select(F.col("user_id").alias("pair"), "event_id", F.when(F.col("event_type").isin("click", "view"), "a").otherwise("b").alias("backend"))
    return S.broken_alternation(rows, "pair", "event_id", "backend", "a", "b")


@query("""WITH s AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'completed' WHEN 'view' THEN 'completed' WHEN 'signup' THEN 'cancelled' WHEN 'purchase' THEN CASE WHEN event_id % 200 = 0 THEN 'uncertain' ELSE 'completed' END ELSE CASE WHEN event_id % 90 = 0 THEN 'invalid_request' ELSE 'failed' END END AS status FROM events),
    o(status, k, code) AS (VALUES ('assessed', 1, 0), ('completed', 2, 0), ('invalid_request', 3, 2), ('output', 4, 1), ('cancelled', 5, 130), ('failed', 6, 1), ('uncertain', 7, 3)), r AS (SELECT user_id, max(k) AS k FROM s JOIN o USING (status) GROUP BY user_id)
    SELECT user_id, status, code FROM r JOIN o USING (k)""")
def exit_codes(spark: SparkSession, sf: str) -> DataFrame:
    k, e = F.col("event_type"), F.col("event_id")
    status = (
        F.when(k.isin("click", "view"), "completed").when(k == "signup", "cancelled").when(k == "purchase", F.when(e % 200 == 0, "uncertain").otherwise("completed")).otherwise(F.when(e % 90 == 0, "invalid_request").otherwise("failed"))
    )
    return journal.exit_codes(X.table(spark, sf, "events").select("user_id", status.alias("status")), "user_id", "status")


@query("""SELECT user_id, arg_min(props, event_id) AS error, min(event_id) AS at_event FROM events WHERE event_type = 'error' GROUP BY user_id""")
def first_failures(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "events").withColumn("error", F.when(F.col("event_type") == "error", F.col("props")))
    return journal.first_failures(rows, "user_id", "event_id", "error").withColumnRenamed("at", "at_event")


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0""")
def byte_conservation(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = X.table(spark, sf, "orders").select(k.alias("id"), k.alias("received"), F.when(k % 11 == 0, k + 1).otherwise(k).alias("written"), F.when(k % 13 == 0, None).otherwise(F.when(k % 11 == 0, k + 1).otherwise(k)).alias("durable"))
    return journal.unconserved(rows).select("id")


@query("""WITH t AS (SELECT user_id AS owner, CASE WHEN event_id % 19 = 0 THEN user_id + 1 ELSE user_id END AS entity, event_id // 2 AS reference, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'success' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'queued' ELSE 'lost' END AS state,
    CASE event_id % 3 WHEN 0 THEN 'VirtualMachine.exportVm' WHEN 1 THEN 'vim.VirtualMachine.powerOff' ELSE 'X' END AS name FROM events), w AS (SELECT *, count(*) OVER (PARTITION BY owner) AS n, count(*) OVER (PARTITION BY owner, reference) AS m FROM t)
    SELECT owner, reference, state, CASE name WHEN 'VirtualMachine.exportVm' THEN 'export_vm' WHEN 'vim.VirtualMachine.powerOff' THEN 'power_off' ELSE 'other' END AS operation, CASE WHEN n > 32 THEN 'too many' WHEN m > 1 THEN 'duplicate' WHEN entity <> owner THEN 'entity' WHEN state = 'lost' THEN 'state' END AS issue FROM w""")
def recent_tasks(spark: SparkSession, sf: str) -> DataFrame:
    e, k = F.col("event_id"), F.col("event_type")
    state = F.when(k == "click", "running").when(k == "view", "success").when(k == "error", "error").when(k == "signup", "queued").otherwise("lost")
    rows = X.table(spark, sf, "events").select(
        F.col("user_id").alias("owner"), F.when(e % 19 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("entity"), F.floor(e / 2).alias("reference"), state.alias("state"), F.when(e % 3 == 0, "VirtualMachine.exportVm").when(e % 3 == 1, "vim.VirtualMachine.powerOff").otherwise("X").alias("name")
    )
    return journal.recent_tasks(rows)


@query("""SELECT * FROM (VALUES ('split', 1, 'RDONLY', 2097152::BIGINT, 51200::BIGINT, 'FLAT', 'a'), ('split', 1, 'RW', 2097152, 51200, 'FLAT', 'b')) t(descriptor_id, position, access, start, length, type, side)""")
def descriptor_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """An embedded descriptor against an external one with another access mode on one extent."""
    d = _descriptors(spark).where("descriptor_id in ('good', 'split')")
    other = d.withColumn("body", F.replace("body", F.lit("RDONLY"), F.lit("RW")))
    return descriptors.same_mapping(descriptors.extents(d), descriptors.extents(other))


@query(with_("extents", """, m AS (SELECT disk_id, seq, start AS file_at, CASE WHEN seq % 5 = 0 THEN start - 512 ELSE start END AS disk_at, length FROM extents WHERE kind = 'data'),
    w AS (SELECT *, max(file_at + length) OVER (PARTITION BY disk_id ORDER BY file_at, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f, max(disk_at + length) OVER (PARTITION BY disk_id ORDER BY disk_at, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM m)
    SELECT disk_id, file_at AS start, 'file' AS "order" FROM w WHERE f > file_at UNION ALL SELECT disk_id, disk_at, 'disk' FROM w WHERE d > disk_at"""))
def fixture_maps(spark: SparkSession, sf: str) -> DataFrame:
    """A map from file to disk offsets must not overlap in either order."""
    m = X.extents(spark, sf).where("kind = 'data'")
    by_file = ranges.overlapping_regions(m).select("disk_id", "start", F.lit("file").alias("order"))
    moved = m.withColumn("start", F.when(F.col("seq") % 5 == 0, F.col("start") - 512).otherwise(F.col("start")))
    return by_file.unionByName(ranges.overlapping_regions(moved).select("disk_id", "start", F.lit("disk").alias("order")))


@query("""WITH i AS (SELECT event_id AS output, CASE WHEN event_id % 5 = 0 THEN 'published' ELSE 'publish_intent' END AS state, event_id % 7 > 0 AS pending, event_id AS inode, props AS record FROM events),
    c AS (SELECT event_id AS output, CASE WHEN event_id % 11 = 0 THEN 'verified' ELSE 'published' END AS cs, CASE WHEN event_id % 13 = 0 THEN 7 ELSE 8 END AS cq, event_id + event_id % 3 AS ci, CASE WHEN event_id % 17 = 0 THEN props || 'x' ELSE props END AS cr FROM events WHERE event_id % 19 > 0)
    SELECT output, CASE WHEN state <> 'publish_intent' OR NOT pending OR cs IS NULL THEN 'transition' WHEN cs <> 'published' OR cq <> 8 OR cr <> record THEN 'record' WHEN ci = inode THEN 'same file' END AS issue FROM i LEFT JOIN c USING (output)""")
def acknowledgment_recovery(spark: SparkSession, sf: str) -> DataFrame:
    e, t = F.col("event_id"), X.table(spark, sf, "events")
    intents = t.select(e.alias("output"), F.when(e % 5 == 0, "published").otherwise("publish_intent").alias("state"), F.lit(7).alias("sequence"), (e % 7 > 0).alias("pending"), e.alias("inode"), F.col("props").alias("record"))
    candidates = t.where("event_id % 19 > 0").select(
        e.alias("output"), F.when(e % 11 == 0, "verified").otherwise("published").alias("state"), F.when(e % 13 == 0, 7).otherwise(8).alias("sequence"), (e + e % 3).alias("inode"), F.when(e % 17 == 0, F.concat("props", F.lit("x"))).otherwise(F.col("props")).alias("record")
    )
    return journal.acknowledgments(intents, candidates)


@query(with_("journal", """, l AS (SELECT artifact, sequence, CASE WHEN sequence % 4 = 0 THEN 'cleaned' WHEN sequence % 4 = 1 THEN 'staged' ELSE state END AS state, sequence % 5 = 0 AS pending, sequence % 3 = 0 AS foreign_ FROM journal)
    SELECT artifact * 100000 + sequence AS job, CASE WHEN foreign_ THEN 'identity' WHEN pending THEN 'uncertain' WHEN state NOT IN ('cleaned', 'staged', 'completed_lease', 'aborted_lease', 'cleanup_intent') THEN 'transition' END AS issue FROM l"""))
def cleanup_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("sequence")
    jobs = X.journal(spark, sf).select(
        (F.col("artifact") * 100000 + s).alias("job"), F.when(s % 4 == 0, "cleaned").when(s % 4 == 1, "staged").otherwise(F.col("state")).alias("state"), (s % 5 == 0).alias("pending"), F.lit(1).alias("operation"), F.when(s % 3 == 0, 2).otherwise(1).alias("asked")
    )
    return journal.cleanup_issues(jobs, "job")


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 9 AS capacity, o_orderkey % 3000 AS max_encoded, (o_orderkey % 30) * 1000 AS timeout, o_orderkey % 2 = 0 AS probe, o_orderkey % 3 = 0 AS inspect, o_orderkey % 5 = 0 AS shutdown, CASE WHEN o_orderkey % 7 > 0 THEN 'out' END AS output FROM orders)
    SELECT id, 'capacity' AS "check" FROM o WHERE capacity <= 0 UNION ALL SELECT id, 'encoded bytes' FROM o WHERE max_encoded < 512 UNION ALL SELECT id, 'timeout' FROM o WHERE timeout <= 0 OR timeout > 21600
    UNION ALL SELECT id, 'output' FROM o WHERE NOT probe AND output IS NULL UNION ALL SELECT id, 'inspect' FROM o WHERE inspect AND (NOT probe OR shutdown)""")
def transfer_options(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    options = X.table(spark, sf, "orders").select(
        k.alias("id"), (k % 9).alias("capacity"), (k % 3000).alias("max_encoded"), (k % 30 * 1000).alias("timeout"), (k % 2 == 0).alias("probe"), (k % 3 == 0).alias("inspect"), (k % 5 == 0).alias("shutdown"), F.when(k % 7 > 0, "out").alias("output")
    )
    return journal.option_violations(options, ["id"])


@query("""SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'unknown field' WHEN 2 THEN 'missing field' WHEN 3 THEN 'version' WHEN 4 THEN 'id' END AS issue, CASE WHEN event_id % 5 = 0 THEN 3600 WHEN event_id % 5 = 1 THEN event_id END AS timeout_seconds FROM events""")
def recovery_configs(spark: SparkSession, sf: str) -> DataFrame:
    from blockloom.sources import records

    e = F.col("event_id")
    ids = F.lit('"artifact_id":"00112233445566778899aabbccddeeff","output_id":"00112233445566778899aabbccddeeff"')
    body = F.concat(
        F.lit('{"schema_version":'), F.when(e % 5 == 3, "2").otherwise("1"), F.lit(',"endpoint":"e","certificate_sha256":"c","pin_provenance":"p","store":"s",'), F.when(e % 5 == 2, "").otherwise('"destination":"d",'),
        F.lit('"selection":{"vm_reference":"v","bios_uuid":"u","disk_key":1,"backing":"b","logical_bytes":512},'), F.when(e % 5 == 4, F.replace(ids, F.lit("ff"), F.lit("fg"))).otherwise(ids),
        F.when(e % 5 == 1, F.concat(F.lit(',"extra":1,"timeout_seconds":'), e)).otherwise(""), F.lit("}"),
    )
    return records.recovery_configs(X.table(spark, sf, "events").select("event_id", body.alias("body"))).select("event_id", "issue", "timeout_seconds")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a/é' ELSE 'a' || chr(65533) END AS display, CASE WHEN event_id % 2 = 1 THEN '61ff' END AS bytes_hex FROM events""")
def path_reports(spark: SparkSession, sf: str) -> DataFrame:
    from blockloom.sources import records

    path = F.when(F.col("event_id") % 2 == 0, F.lit("a/é").cast("binary")).otherwise(F.unhex(F.lit("61FF")))
    return records.path_reports(X.table(spark, sf, "events").select("event_id", path.alias("path"))).select("event_id", "display", "bytes_hex")
