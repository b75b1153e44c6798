"""Queries over journals, inventories, descriptors, headers and records."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import binary as B
from blockloom.operators import inventory, journal, ranges
from blockloom.plans import fixtures as X
from blockloom.plans.fixtures import with_
from blockloom.plans.registry import query
from blockloom.sources import descriptors, images, records

_STEPS = ", ".join(f"('{a}', '{b}')" for a, b in journal.STEPS)
_SEQUENCES = ", ".join(f"('{s}', {n})" for s, all_ in journal.SEQUENCES.items() for n in all_)
_ACTIONS = ", ".join(f"('{s}', '{a}')" for s, a in journal.ACTIONS.items())
_LEASED = ", ".join(f"'{s}'" for s in journal.LEASED)
_UNLEASED = ", ".join(f"'{s}'" for s in journal.UNLEASED)


@query(with_("journal", f""", s(before, state) AS (VALUES {_STEPS}), m AS (SELECT *, lag(state) OVER (PARTITION BY artifact ORDER BY sequence) AS before FROM journal)
    SELECT artifact, sequence, before, state FROM m WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.before = m.before AND s.state = m.state)"""))
def journal_illegal_edges(spark: SparkSession, sf: str) -> DataFrame:
    return journal.illegal_steps(X.journal(spark, sf)).select("artifact", "sequence", "before", "state")


@query(with_("journal", f""", q(state, n) AS (VALUES {_SEQUENCES})
    SELECT artifact, sequence, 'sequence' AS "check" FROM journal j WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.state = j.state AND q.n = j.sequence) UNION ALL
    SELECT artifact, sequence, 'stage' FROM journal WHERE (state NOT IN ('prepared', 'stage_intent')) <> has_stage UNION ALL
    SELECT artifact, sequence, 'lease' FROM journal WHERE (state IN ({_LEASED}) AND NOT has_lease) OR (state IN ({_UNLEASED}) AND has_lease) OR (state IN ('cleanup_intent', 'cleaned') AND has_lease <> (sequence >= 7))"""))
def journal_record_checks(spark: SparkSession, sf: str) -> DataFrame:
    return journal.record_violations(X.journal(spark, sf), ["artifact", "sequence"])


@query(with_("journal", f""", a(state, action) AS (VALUES {_ACTIONS}), l AS (SELECT artifact, arg_max(state, sequence) AS state, max(sequence) AS sequence FROM journal GROUP BY artifact)
    SELECT artifact, state, sequence, action FROM l JOIN a USING (state)"""))
def journal_assess(spark: SparkSession, sf: str) -> DataFrame:
    return journal.assess(X.journal(spark, sf))


@query(with_("journal", """SELECT artifact, ts, CAST(CASE WHEN sequence % 9 = 8 THEN sequence + 1 ELSE sequence END AS BIGINT) AS sequence, CAST(sequence AS BIGINT) AS expected FROM journal WHERE sequence % 9 = 8 OR sequence > 32"""))
def journal_sequence_numbers(spark: SparkSession, sf: str) -> DataFrame:
    j = X.journal(spark, sf).withColumn("sequence", F.when(F.col("sequence") % 9 == 8, F.col("sequence") + 1).otherwise(F.col("sequence")))
    return journal.broken_sequences(j).select("artifact", "ts", "sequence", "expected")


_OUT = ", ".join(f"('{s}', {n})" for s, n in journal.OUTPUT_SEQUENCES.items())
_OUT_NAMES = list(journal.OUTPUT_SEQUENCES)


@query(f"""WITH q(state, n) AS (VALUES {_OUT}), r AS (SELECT event_id AS id, (SELECT state FROM q WHERE n = event_id % 9) AS plain, event_id % 4 AS c, CAST(event_id % 11 AS BIGINT) AS sequence, event_id % 2 = 0 AS has_stage, event_id % 3 = 0 AS has_digest FROM events),
    s AS (SELECT id, sequence, has_stage, has_digest, CASE c WHEN 2 THEN 'cleanup_intent' WHEN 3 THEN 'cleaned' ELSE plain END AS state, (SELECT n FROM q WHERE q.state = plain) AS o, c FROM r),
    e AS (SELECT *, o + CASE c WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS expected FROM s)
    SELECT id, 'sequence' AS "check" FROM e WHERE sequence <> expected UNION ALL SELECT id, 'stage' FROM e WHERE has_stage <> (o >= 2) UNION ALL SELECT id, 'digest' FROM e WHERE has_digest <> (o >= 6)""")
def output_record_checks(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    plain = F.element_at(F.array(*map(F.lit, _OUT_NAMES)), (e % 9 + 1).cast("int"))
    rows = X.table(spark, sf, "events").select(
        e.alias("id"), F.when(e % 4 == 2, "cleanup_intent").when(e % 4 == 3, "cleaned").otherwise(plain).alias("state"), plain.alias("origin"), (e % 11).alias("sequence"), (e % 2 == 0).alias("has_stage"), (e % 3 == 0).alias("has_digest")
    )
    return journal.output_violations(rows, ["id"])


_PLACES = """WITH p AS (SELECT event_id AS artifact, CASE event_id % 3 WHEN 0 THEN 'published' ELSE 'publish_intent' END AS state, event_id % 5 = 0 AS pending, CASE event_id % 4 WHEN 0 THEN 'absent' WHEN 1 THEN 'foreign' ELSE 'owned' END AS staged,
    CASE event_id % 7 WHEN 0 THEN 'foreign' WHEN 1 THEN 'owned' WHEN 2 THEN 'owned' ELSE 'absent' END AS final FROM events) """


def _places(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return X.table(spark, sf, "events").select(
        e.alias("artifact"), F.when(e % 3 == 0, "published").otherwise("publish_intent").alias("state"), (e % 5 == 0).alias("pending"), F.when(e % 4 == 0, "absent").when(e % 4 == 1, "foreign").otherwise("owned").alias("staged"),
        F.when(e % 7 == 0, "foreign").when((e % 7).isin(1, 2), "owned").otherwise("absent").alias("final"),
    )


@query(_PLACES + """SELECT artifact, CASE WHEN state <> 'publish_intent' OR pending THEN 'not eligible' WHEN staged = 'owned' AND final = 'absent' THEN 'staged' WHEN staged = 'absent' AND final = 'owned' THEN 'already renamed' ELSE 'identity' END AS outcome FROM p""")
def publication_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return journal.reconcile(_places(spark, sf))


@query(_PLACES + """SELECT artifact, state = 'published' AND NOT pending AND staged = 'absent' AND final = 'owned' AS eligible FROM p""")
def publication_attest(spark: SparkSession, sf: str) -> DataFrame:
    return journal.attest(_places(spark, sf))


@query("""SELECT user_id, bool_and(event_id % 9 <> 0) AND bool_or(event_type = 'purchase') AS success FROM events GROUP BY user_id""")
def pipeline_success(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "events").select("user_id", F.when(F.col("event_type") == "purchase", "completed").otherwise("running").alias("phase"), (F.col("event_id") % 9 != 0).alias("ok"))
    return journal.successes(rows, "user_id", "phase", "ok")


@query("""WITH g AS (SELECT user_id, event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS gap_seconds FROM events) SELECT user_id, event_id, round(gap_seconds, 6) AS gap_seconds FROM g WHERE gap_seconds > 36000""")
def late_heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    return journal.late_heartbeats(X.table(spark, sf, "events"), "user_id", "ts", 36000).select("user_id", "event_id", F.round("gap_seconds", 6).alias("gap_seconds"))


@query(with_("accesses", """, l AS (SELECT * FROM accesses WHERE length > 0 OR flush)
    SELECT a.file_id, a.req_id AS req_a, b.req_id AS req_b FROM l a JOIN l b ON a.file_id = b.file_id AND a.req_id < b.req_id WHERE a.flush OR b.flush
    OR (a.start < b.start + b.length AND b.start < a.start + a.length AND (a.writes OR b.writes))
    OR (a.direct <> b.direct AND a.start // 4096 <= (b.start + b.length - 1) // 4096 AND b.start // 4096 <= (a.start + a.length - 1) // 4096)"""))
def access_conflict(spark: SparkSession, sf: str) -> DataFrame:
    return journal.access_conflicts(X.accesses(spark, sf))


@query("""WITH e AS (SELECT event_type AS kind, event_id AS pos, 1 AS d FROM events UNION ALL SELECT event_type, event_id + 5 + event_id % 40, -1 FROM events), r AS (SELECT kind, sum(d) OVER (PARTITION BY kind ORDER BY pos, d ROWS UNBOUNDED PRECEDING) AS n FROM e)
    SELECT kind, CAST(max(n) AS BIGINT) AS peak FROM r GROUP BY kind""")
def peak_in_flight(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("begin"), (F.col("event_id") + 5 + F.col("event_id") % 40).alias("end"))
    return journal.peak_in_flight(rows, "kind", "begin", "end")


@query(with_("edges", """, w AS (SELECT 'root' AS node, 0 AS level UNION ALL SELECT e.child, w.level + 1 FROM w JOIN edges e ON e.parent = w.node) SELECT node, min(level) AS level FROM w GROUP BY node"""))
def inventory_bfs(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.walk(X.edges(spark, sf), spark.createDataFrame([("root",)], "node string"))


@query("""WITH v AS (SELECT c_custkey AS id, c_custkey % 9 = 0 AS template, c_custkey % 11 = 0 AS snap, c_custkey % 3 + 1 AS n, c_custkey % 5 = 0 AS enc, c_custkey % 7 = 0 AS par, CASE WHEN c_custkey % 4 = 0 THEN 'independent_persistent' ELSE 'persistent' END AS md,
    CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 2000 END AS k, CASE WHEN c_custkey % 2 = 0 THEN 1048576 ELSE 2097152 END AS cap FROM customer)
    SELECT id FROM v WHERE NOT template AND NOT snap AND n = 1 AND NOT enc AND NOT par AND md = 'persistent' AND k IS NOT NULL AND cap = 1048576""")
def vm_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    disk = F.struct(
        F.when(k % 2 == 0, 1048576).otherwise(2097152).cast("long").alias("capacity_bytes"), F.lit(inventory.FLAT_BACKING).alias("backing_type"), F.when(k % 4 == 0, "independent_persistent").otherwise("persistent").alias("disk_mode"),
        (k % 5 == 0).alias("encrypted"), (k % 7 == 0).alias("parent_present"), F.when(k % 13 != 0, 2000).cast("long").alias("device_key"), F.lit("[store] disk").alias("backing"),
    )
    vms = X.table(spark, sf, "customer").select(k.alias("id"), (k % 9 == 0).alias("template"), (k % 11 == 0).alias("snapshot_present"), F.lit(1048576).cast("long").alias("capacity"), F.array_repeat(disk, (k % 3 + 1).cast("int")).alias("disks"))
    return inventory.eligible(vms).select("id")


@query("""SELECT CAST(floor(c_acctbal) AS BIGINT) AS balance, CASE WHEN count(*) = 1 THEN min(c_custkey) END AS c_custkey, CASE WHEN count(*) > 1 THEN 'several' END AS issue FROM customer GROUP BY 1""")
def exactly_one(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "customer").select(F.floor("c_acctbal").cast("long").alias("balance"), "c_custkey")
    return inventory.exactly_one(rows, "balance", "c_custkey")


@query("""WITH w AS (SELECT s_suppkey AS wanted_id, s_suppkey + s_suppkey % 2 * 100000 AS reference, CASE WHEN s_suppkey % 3 = 0 THEN 'E2' ELSE 'E1' END AS endpoint, CASE WHEN s_suppkey % 5 = 0 THEN upper(s_name) ELSE s_name || 'x' END AS uuid, s_nationkey AS disk_key, 'b' || s_suppkey % 4 AS backing FROM supplier),
    v AS (SELECT s_suppkey AS reference, 'E1' AS endpoint, s_name AS uuid, s_nationkey % 20 AS disk_key, 'b' || s_suppkey % 3 AS backing, CASE WHEN s_suppkey % 7 = 0 THEN 'poweredOn' ELSE 'poweredOff' END AS power FROM supplier),
    j AS (SELECT w.wanted_id, v.reference AS r, w.endpoint <> v.endpoint AS e, lower(w.uuid) <> lower(v.uuid) AS u, w.disk_key <> v.disk_key AS d, w.backing <> v.backing AS b, v.power <> 'poweredOff' AS p FROM w LEFT JOIN v ON w.reference = v.reference)
    SELECT wanted_id, 'missing' AS "check" FROM j WHERE r IS NULL UNION ALL SELECT wanted_id, 'endpoint' FROM j WHERE e UNION ALL SELECT wanted_id, 'uuid' FROM j WHERE u UNION ALL SELECT wanted_id, 'disk key' FROM j WHERE d
    UNION ALL SELECT wanted_id, 'backing' FROM j WHERE b UNION ALL SELECT wanted_id, 'powered on' FROM j WHERE p""")
def source_selection(spark: SparkSession, sf: str) -> DataFrame:
    s, k = X.table(spark, sf, "supplier"), F.col("s_suppkey")
    wanted = s.select(
        k.alias("wanted_id"), (k + k % 2 * 100000).alias("reference"), F.when(k % 3 == 0, "E2").otherwise("E1").alias("endpoint"), F.when(k % 5 == 0, F.upper("s_name")).otherwise(F.concat("s_name", F.lit("x"))).alias("uuid"),
        F.col("s_nationkey").alias("disk_key"), F.concat(F.lit("b"), k % 4).alias("backing"),
    )
    vms = s.select(k.alias("reference"), F.lit("E1").alias("endpoint"), F.col("s_name").alias("uuid"), (F.col("s_nationkey") % 20).alias("disk_key"), F.concat(F.lit("b"), k % 3).alias("backing"), F.when(k % 7 == 0, "poweredOn").otherwise("poweredOff").alias("power_state"))
    return inventory.select_source(vms, wanted)


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN source || '/' || lang WHEN 1 THEN '../' || source WHEN 2 THEN source || '//x' WHEN 3 THEN 'c:' || source WHEN 4 THEN source || chr(92) || lang ELSE source || '/./' || lang END AS name FROM documents)
    SELECT doc_id, name, name <> '' AND NOT contains(name, chr(92)) AND NOT contains(name, ':') AND len(list_filter(string_split(name, '/'), lambda p: p IN ('', '.', '..'))) = 0 AS safe FROM t""")
def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id") % 6
    name = (
        F.when(d == 0, F.concat_ws("/", "source", "lang")).when(d == 1, F.concat(F.lit("../"), "source")).when(d == 2, F.concat("source", F.lit("//x"))).when(d == 3, F.concat(F.lit("c:"), "source"))
        .when(d == 4, F.concat_ws("\\", "source", "lang")).otherwise(F.concat("source", F.lit("/./"), "lang"))
    )
    return X.table(spark, sf, "documents").select("doc_id", name.alias("name")).withColumn("safe", inventory.safe_name(F.col("name")))


@query(r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS authority FROM pages), h AS (SELECT *, regexp_extract(authority, '([^@:]*)(:[0-9]*)?$', 1) AS host, regexp_extract(authority, ':([0-9]+)$', 1) AS port FROM u)
    SELECT page_id, CASE WHEN url IS NULL OR host = '' THEN 'shape' WHEN NOT starts_with(url, 'https://') THEN 'scheme' WHEN host <> 'm.ththth.example.net' THEN 'host' WHEN port NOT IN ('', '443') THEN 'port' WHEN contains(authority, '@') THEN 'user' WHEN contains(url, '#') THEN 'fragment'
    WHEN NOT regexp_matches(url, '^https://[^/]+/(nfc|ha-nfc)/') THEN 'path' END AS issue FROM h""")
def data_url_admission(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "pages").select("page_id", inventory.url_issue(F.col("url"), "m.ththth.example.net", 443).alias("issue"))


@query("""WITH a AS (SELECT o_orderkey AS artifact, o_orderkey % 3 > 0 AS complete, CASE WHEN o_orderkey % 4 > 0 THEN CASE WHEN o_orderkey % 10 = 1 THEN 'XY' ELSE sha256(CAST(o_orderkey AS VARCHAR)) END END AS digest, (o_orderkey % 50) * CASE WHEN o_orderkey % 7 = 0 THEN 100 ELSE 512 END AS capacity FROM orders)
    SELECT artifact, 'digest' AS "check" FROM a WHERE complete <> (digest IS NOT NULL) UNION ALL SELECT artifact, 'capacity' FROM a WHERE capacity <= 0 OR capacity % 512 <> 0 UNION ALL SELECT artifact, 'digest shape' FROM a WHERE digest = 'XY'""")
def artifact_contract(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    digest = F.when(k % 4 > 0, F.when(k % 10 == 1, "XY").otherwise(F.sha2(k.cast("string"), 256)))
    return inventory.artifact_violations(X.table(spark, sf, "orders").select(k.alias("artifact"), (k % 3 > 0).alias("complete"), digest.alias("digest"), (k % 50 * F.when(k % 7 == 0, 100).otherwise(512)).alias("capacity")))


@query("""SELECT user_id AS object_id, event_type AS name, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1""")
def duplicate_properties(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.duplicate_properties(X.table(spark, sf, "events").select(F.col("user_id").alias("object_id"), F.col("event_type").alias("name")))


@query("""WITH p AS (SELECT DISTINCT user_id, event_type FROM events) SELECT o.user_id AS object_id, r.name FROM (SELECT DISTINCT user_id FROM p) o CROSS JOIN (SELECT unnest(['click', 'view', 'resize']) AS name) r
    WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = o.user_id AND p.event_type = r.name)""")
def missing_properties(spark: SparkSession, sf: str) -> DataFrame:
    p = X.table(spark, sf, "events").select(F.col("user_id").alias("object_id"), F.lit("vm").alias("kind"), F.col("event_type").alias("name"))
    return inventory.missing_properties(p, spark.createDataFrame([("vm", "click"), ("vm", "view"), ("vm", "resize")], "kind string, name string"))


@query("""SELECT p, s, c, m, CASE WHEN p AND s THEN 'published' WHEN p THEN 'published, durability unknown' WHEN c THEN 'temporary left' WHEN m THEN 'destination modified' ELSE 'destination unchanged' END AS state
    FROM (SELECT unnest([true, false]) AS p) CROSS JOIN (SELECT unnest([true, false]) AS s) CROSS JOIN (SELECT unnest([true, false]) AS c) CROSS JOIN (SELECT unnest([true, false]) AS m)""")
def failure_states(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    rows = spark.range(16).select(*[(F.shiftright(i, b) % 2 == 1).alias(n) for b, n in enumerate("pscm")])
    return rows.withColumn("state", inventory.failure_state(*[F.col(c) for c in "pscm"]))


@query("""WITH t AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS e, o_orderkey % 3 > 0 AS o, o_orderkey % 5 > 0 AS r, o_orderkey % 7 = 0 AS a, o_orderkey % 1000 AS have, o_custkey % 1000 AS need FROM orders)
    SELECT id, CASE WHEN NOT e THEN NULL WHEN NOT o THEN 'exists' WHEN NOT r THEN 'not a regular file' WHEN a THEN 'alias of the source' WHEN have < need THEN 'too small' END AS issue, CASE WHEN e THEN greatest(have - need, 0) ELSE 0 END AS preserved FROM t""")
def destination_policy(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = X.table(spark, sf, "orders").select(k.alias("id"), (k % 2 == 0).alias("e"), (k % 3 > 0).alias("o"), (k % 5 > 0).alias("r"), (k % 7 == 0).alias("a"), (k % 1000).alias("have"), (F.col("o_custkey") % 1000).alias("need"))
    issue = inventory.destination_issue(*[F.col(c) for c in ("e", "o", "r", "a", "have", "need")])
    return rows.select("id", issue.alias("issue"), F.when(F.col("e"), B.less(F.col("have"), F.col("need"))).otherwise(0).alias("preserved"))


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS good, true AS good_ok, 'x' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS bad, false AS bad_ok, strftime(o_orderdate, '%Y-%m-%dT23:59:60.5Z') AS leap, true AS leap_ok, strftime(o_orderdate, '%Y-02-30T00:00:00Z') AS day, false AS day_ok FROM orders""")
def utc_stamps(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda fmt: F.date_format("o_orderdate", fmt)
    rows = X.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), at("yyyy-MM-dd'T'HH:mm:ss'Z'").alias("good"), F.concat(F.lit("x"), at("yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("bad"), at("yyyy-MM-dd'T23:59:60.5Z'").alias("leap"), at("yyyy-'02-30T00:00:00Z'").alias("day")
    )
    return rows.select("id", *[x for c in ("good", "bad", "leap", "day") for x in (F.col(c), B.strict_utc(F.col(c)).alias(f"{c}_ok"))])


@query("""SELECT o_orderkey AS id, (o_orderkey + 511) // 512 AS blocks, (o_orderkey + 511) // 512 * 512 AS rounded, o_orderkey > 0 AND (o_orderkey & (o_orderkey - 1)) = 0 AS power, o_orderkey % 64 = 0 AS multiple, greatest(o_orderkey - o_custkey, 0) AS less, (o_orderkey & 5) = 5 AS flags,
    lower(to_hex(o_orderkey)) AS hex FROM orders""")
def scalar_numbers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return X.table(spark, sf, "orders").select(
        k.alias("id"), B.ceil_div(k, 512).alias("blocks"), B.round_up(k).alias("rounded"), B.is_power_of_two(k).alias("power"), B.is_multiple(k, 64).alias("multiple"), B.less(k, F.col("o_custkey")).alias("less"), B.has_all(k, 5).alias("flags"), F.lower(F.hex(k)).alias("hex")
    )


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped, sha1(html) AS sha1, octet_length(encode(html)) BETWEEN 1 AND 2000 AND NOT regexp_matches(html, '[\\x00-\\x1F\\x7F]') AS bounded FROM pages""")
def scalar_texts(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("html")
    return X.table(spark, sf, "pages").select("page_id", B.xml_escaped(h).alias("escaped"), F.sha1(h.cast("binary")).alias("sha1"), inventory.bounded_text(h, 2000).alias("bounded"))


@query("""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS data FROM documents), p AS (SELECT doc_id, data, unnest(range(0, greatest(1, (octet_length(data) + 65535) // 65536))) AS part FROM d),
    g AS (SELECT doc_id, part, data[CAST(part * 65536 + 1 AS INTEGER):CAST((part + 1) * 65536 AS INTEGER)] AS bytes FROM p)
    SELECT 'd' || CASE WHEN part > 0 THEN CAST(part AS VARCHAR) ELSE '' END AS disk_id, doc_id AS index, CASE WHEN doc_id % 5 = 0 THEN CAST(65536 AS BIGINT) END AS n_bytes,
        CASE WHEN doc_id % 5 = 0 THEN sha256(bytes || repeat('\\x00'::BLOB, 65536 - octet_length(bytes))) END AS sha256, CASE doc_id % 5 WHEN 1 THEN 'too short' WHEN 2 THEN 'truncated' WHEN 3 THEN 'trailing input' WHEN 4 THEN 'not zlib' END AS issue FROM g""")
def inflate_check(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's bytes as 64 KiB grains, the last one padded, compressed, with every kind of damage; the disk is told by
    the grain's place in its document and the index is the document."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(text.as_buffer()) if text.is_valid else b""
                disks, payloads = [], []
                for part, at in enumerate(range(0, max(len(data), 1), images.STREAM_GRAIN)):
                    grain = bytes(data[at : at + images.STREAM_GRAIN]).ljust(images.STREAM_GRAIN, b"\0")
                    z = zlib.compress(grain[:-1] if doc % 5 == 1 else grain)
                    payloads.append(z[:-3] if doc % 5 == 2 else z + b"x" if doc % 5 == 3 else b"\x1f\x8b" + z if doc % 5 == 4 else z)
                    disks.append(f"d{part or ''}")
                yield pa.RecordBatch.from_pydict({"disk_id": disks, "index": [doc] * len(disks), "payload": pa.array(payloads, pa.binary())})

    return images.inflate(X.table(spark, sf, "documents").select("doc_id", "text").mapInArrow(packed, "disk_id string, index long, payload binary"))


DESCRIPTORS = {
    "good": 'version=1\nCID=fffffffe\nparentCID=ffffffff\ncreateType="monolithicFlat"\nRW 2048 FLAT "a-flat.bin" 0\nddb.adapterType = "lsilogic"',
    "split": 'version=1\nCID=12345678\nparentCID=ffffffff\ncreateType="twoGbMaxExtentFlat"\n# extents\nRW 4096 FLAT "a1" 0\nRDONLY 100 FLAT "a2" 0\n',
    "custom": 'version=1\r\nCID=12345678\r\nparentCID=ffffffff\r\ncreateType="custom"\r\nRW 8 ZERO\r\nRW 8 FLAT "x" 16\r\nRW 8 FLAT "x" 0',
    "no version": 'CID=12345678\nparentCID=ffffffff\ncreateType="custom"\nRW 8 ZERO',
    "twice": 'version=1\nversion=1\nCID=12345678\nparentCID=ffffffff\ncreateType="custom"\nRW 8 ZERO',
    "late header": 'version=1\nCID=12345678\nparentCID=ffffffff\ncreateType="custom"\nRW 8 ZERO\nencoding="UTF-8"',
    "bad cid": 'version=1\nCID=123\nparentCID=ffffffff\ncreateType="custom"\nRW 8 ZERO',
    "child": 'version=1\nCID=12345678\nparentCID=00000001\ncreateType="custom"\nRW 8 ZERO',
    "two": 'version=1\nCID=12345678\nparentCID=ffffffff\ncreateType="monolithicFlat"\nRW 8 FLAT "a" 0\nRW 8 FLAT "b" 0',
    "empty": 'version=1\nCID=12345678\nparentCID=ffffffff\ncreateType="custom"\nRW 0 ZERO',
    "quote": 'version=1\nCID=12345678\nparentCID=ffffffff\ncreateType="custom\nRW 8 ZERO',
    "no extents": 'version=1\nCID=12345678\nparentCID=ffffffff\ncreateType="custom"',
    "ddb first": 'version=1\nddb.uuid="1"\nCID=12345678\nparentCID=ffffffff\ncreateType="custom"\nRW 8 ZERO',
    "sparse": 'version=1\nCID=1\nparentCID=ffffffff\ncreateType="monolithicSparse"\nRW 2048 SPARSE "s.bin"\n\x00\x00\x00',
}


def _descriptors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DESCRIPTORS.items()), "descriptor_id string, body string")


@query("""SELECT * FROM (VALUES ('custom', 0, 'RW', 0::BIGINT, 4096::BIGINT, 'ZERO', NULL, NULL::BIGINT), ('custom', 1, 'RW', 4096, 4096, 'FLAT', 'x', 8192), ('custom', 2, 'RW', 8192, 4096, 'FLAT', 'x', 0), ('good', 0, 'RW', 0, 1048576, 'FLAT', 'a-flat.bin', 0),
    ('split', 0, 'RW', 0, 2097152, 'FLAT', 'a1', 0), ('split', 1, 'RDONLY', 2097152, 51200, 'FLAT', 'a2', 0)) t(descriptor_id, position, access, start, length, type, file_name, backing_start)""")
def descriptor_rows(spark: SparkSession, sf: str) -> DataFrame:
    return descriptors.extents(_descriptors(spark).where("descriptor_id in ('good', 'split', 'custom')"))


@query("""SELECT * FROM (VALUES ('no version', 0, 'missing version'), ('twice', 2, 'duplicate'), ('late header', 6, 'late header'), ('bad cid', 2, 'number'), ('child', 3, 'unwanted parent'), ('two', 6, 'one extent'), ('empty', 5, 'empty extent'),
    ('quote', 4, 'unterminated quote'), ('no extents', 0, 'missing extents'), ('ddb first', 2, 'early ddb'), ('sparse', 2, 'number')) t(descriptor_id, line, issue)""")
def descriptor_violations(spark: SparkSession, sf: str) -> DataFrame:
    return descriptors.violations(_descriptors(spark))


@query("""SELECT * FROM (VALUES ('custom', 'x', 1, 12288::BIGINT), ('good', 'a-flat.bin', 0, 1048576), ('split', 'a1', 0, 2097152), ('split', 'a2', 1, 51200)) t(descriptor_id, file_name, first_position, required_bytes)""")
def descriptor_backings(spark: SparkSession, sf: str) -> DataFrame:
    return descriptors.backings(descriptors.extents(_descriptors(spark).where("descriptor_id in ('good', 'split', 'custom')")))


@query("""SELECT * FROM (VALUES ('good', 'flat', NULL, NULL), ('sparse', 'sparse', NULL, NULL), ('child', NULL, 3, 'unwanted parent')) t(descriptor_id, variant, line, issue)""")
def descriptor_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return descriptors.with_fallback(_descriptors(spark).where("descriptor_id in ('good', 'sparse', 'child')"))


@query("""SELECT doc_id, octet_length(encode(text)) AS n, true AS intact FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, octet_length(encode(text)), false FROM documents WHERE doc_id % 3 = 0""")
def journal_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "documents").select("doc_id", F.col("text").alias("record"), F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("checksum"))
    return records.journal_envelopes(rows).select("doc_id", F.octet_length("record").cast("long").alias("n"), "intact")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 'unknown field' WHEN event_id % 4 = 2 THEN 'missing field' WHEN event_id % 4 = 3 THEN 'version' END AS issue, CASE WHEN event_id % 4 <> 2 THEN event_id * 512 END AS capacity FROM events""")
def artifact_json(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    body = F.concat(
        F.lit('{"schema_version":'), F.when(e % 4 == 3, "2").otherwise("1"), F.lit(',"artifact":"a","complete":false,"encoded_bytes":7'), F.when(e % 4 == 2, "").otherwise(F.concat(F.lit(',"capacity":'), (e * 512).cast("string"))), F.when(e % 4 == 1, ',"extra":1').otherwise(""), F.lit("}")
    )
    return records.artifacts(X.table(spark, sf, "events").select("event_id", body.alias("body"))).select("event_id", "issue", "capacity")


@query(with_("edges", """SELECT parent, child FROM edges WHERE parent LIKE 'n%' OR parent LIKE 'r%'"""))
def inventory_xml(spark: SparkSession, sf: str) -> DataFrame:
    kids = X.edges(spark, sf).groupBy("parent").agg(F.collect_list(F.concat(F.lit("<child>"), "child", F.lit("</child>"))).alias("c"))
    body = F.concat(F.lit("<object><id>"), "parent", F.lit("</id><kind>folder</kind><children>"), F.array_join("c", ""), F.lit("</children></object>"))
    return records.object_edges(records.objects(kids.select(body.alias("body"))))


@query("""SELECT CAST(user_id AS VARCHAR) AS target, event_id AS executions, event_id % 91 AS coverage, event_id % 17 AS features FROM events WHERE event_id % 3 > 0""")
def fuzz_log(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    line = F.when(e % 3 > 0, F.concat(F.lit("#"), e, F.lit("\tNEW    cov: "), e % 91, F.lit(" ft: "), e % 17, F.lit(" corp: 9/9b exec/s: 100 rss: 50Mb"))).otherwise("INFO: nothing")
    return records.fuzz_progress(X.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("target"), line.alias("line"))).select("target", "executions", "coverage", "features")


@query("""SELECT event_id AS run, event_type AS call, event_id % 100 AS calls, CASE WHEN event_id % 2 = 0 THEN event_id % 7 ELSE 0 END AS errors FROM events""")
def call_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    line = F.concat(F.lit(" 12.34    0.000123          12       "), e % 100, F.when(e % 2 == 0, F.concat(F.lit("        "), e % 7)).otherwise(""), F.lit(" "), "event_type")
    return records.call_summary(X.table(spark, sf, "events").select(e.alias("run"), line.alias("line")))


@query("""SELECT doc_id AS path, doc_id % 10 = 0 AS gone FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 0""")
def source_stamps(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    before = X.table(spark, sf, "documents").select(d.alias("path"), F.col("n_chars").alias("size"), F.lit(1).alias("modified"))
    after = before.where("path % 10 <> 0").withColumn("size", F.when(F.col("path") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return records.changed_files(before, after)
