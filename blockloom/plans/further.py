"""Queries over sinks, discovery, running copies, sessions, retained artifacts, pages and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import binary as B
from blockloom.operators import control, inventory, planning, verify
from blockloom.operators import statistics as S
from blockloom.operators.support import cut, remove, shared_folder
from blockloom.plans import fixtures as X
from blockloom.plans.fixtures import with_
from blockloom.plans.records import inflate_check
from blockloom.plans.registry import query
from blockloom.sources import images, records, sinks

#: Blocks of 512 bytes, every other one missing: what a raw image is written from.
_BLOCKS = """b AS (SELECT doc_id % 20 AS disk_id, (row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) - 1) AS i, repeat(sha256(encode(coalesce(text, ''))), 16) AS h FROM documents)"""


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy(F.col("doc_id") % 20).orderBy("doc_id")) - 1
    data = F.unhex(F.repeat(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 16))
    return X.table(spark, sf, "documents").select((F.col("doc_id") % 20).alias("disk_id"), (i.cast("long") * 1024).alias("start"), data.alias("bytes"))


@query(f"""WITH {_BLOCKS} SELECT CAST(disk_id AS VARCHAR) AS disk_id, CAST(count(*) * 1024 - 512 AS BIGINT) AS n_bytes, sha256(unhex(string_agg(h, repeat('00', 512) ORDER BY i))) AS sha256, CAST(count(*) * 2 - 1 AS BIGINT) AS n_blocks, true AS same FROM b GROUP BY disk_id""")
def raw_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Raw images in parts of 64 KiB, written from blocks, read back by ``raw_blocks`` and hashed whole."""
    blocks = _blocks(spark, sf)
    folder = shared_folder(blocks)
    files = sinks.write_raw(blocks, folder, part=1 << 16)
    spark.dataSource.register(images.RawBlocks)
    read = None
    for row in files.select("disk_id").distinct().collect():  # a disk a data source; there are twenty
        paths = files.where(F.col("disk_id") == row["disk_id"]).orderBy("part").select("part", "path").collect()
        for part, path in paths:
            one = spark.read.format("raw_blocks").option("path", path).option("block", "512").load()
            one = one.select(F.lit(row["disk_id"]).alias("disk_id"), (F.col("block_no") + part * 128).alias("block_no"), "bytes")
            read = one if read is None else read.unionByName(one)
    got = verify.ordered_digest(read).select("disk_id", "sha256", "n_blocks")
    sizes = files.groupBy("disk_id").agg(F.sum("n_bytes").cast("long").alias("n_bytes"))
    again = files.join(sinks.write_raw(blocks, folder + "-again", part=1 << 16).select("disk_id", "part", F.col("sha256").alias("_s")), ["disk_id", "part"]).groupBy("disk_id").agg(F.bool_and(F.col("sha256") == F.col("_s")).alias("same"))
    out = cut(got.join(sizes, "disk_id").join(again, "disk_id").select("disk_id", "n_bytes", "sha256", "n_blocks", "same"))
    remove(blocks, folder)
    remove(blocks, folder + "-again")
    return out


@query("""WITH b AS (SELECT doc_id % 40 AS disk_id, doc_id, octet_length(encode(text)) AS length, doc_id % 3 = 0 AS zero FROM documents WHERE octet_length(encode(text)) > 0),
    p AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY disk_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, CASE WHEN zero = lag(zero) OVER (PARTITION BY disk_id ORDER BY doc_id) THEN 0 ELSE 1 END AS new FROM b),
    r AS (SELECT *, sum(new) OVER (PARTITION BY disk_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM p), s AS (SELECT disk_id, sum(length) AS size FROM b GROUP BY disk_id)
    SELECT disk_id, CAST(min(start) AS BIGINT) AS start, CAST(sum(length) AS BIGINT) AS length, CASE WHEN zero THEN 'hole' ELSE 'data' END AS kind, CAST(NULL AS VARCHAR) AS issue FROM r WHERE disk_id % 7 <> 0 AND disk_id % 9 <> 0 GROUP BY disk_id, run, zero
    UNION ALL SELECT disk_id, 0, CAST(size AS BIGINT), 'data', NULL FROM s WHERE disk_id % 7 = 0 AND disk_id % 9 <> 0 UNION ALL SELECT disk_id, NULL, NULL, NULL, 'shrunk' FROM s WHERE disk_id % 9 = 0""")
def sparse_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """Forty disks of the texts' bytes one after the other, every third text as zeros."""
    from pyspark.sql import Window

    d, n = F.col("doc_id") % 40, F.octet_length("text").cast("long")
    before = F.coalesce(F.sum(n).over(Window.partitionBy(d).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    data = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.repeat(F.lit("00"), n.cast("int")))).otherwise(F.col("text").cast("binary"))
    blocks = X.table(spark, sf, "documents").where(n > 0).select(d.alias("disk_id"), before.alias("start"), data.alias("bytes"))
    size = F.sum(F.octet_length("bytes")).cast("long")
    queries = blocks.groupBy("disk_id").agg(size.alias("size"), (size - F.when(F.col("disk_id") % 9 == 0, 1).otherwise(0)).alias("size_after"), (F.col("disk_id") % 7 != 0).alias("supported"))
    return images.discover(blocks, queries)


@query("""WITH RECURSIVE p AS (SELECT user_id AS copy_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, CAST(sum(CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(floor(value * 100000) AS BIGINT) END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes,
        event_id // 8 AS elapsed_ms FROM events),
    q AS (SELECT *, bytes <> lag(bytes, 1, 0) OVER (PARTITION BY copy_id ORDER BY seq) AS moved FROM p),
    r AS (SELECT copy_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS told, CAST(0 AS BIGINT) AS at, false AS emit FROM (SELECT DISTINCT copy_id FROM q) UNION ALL
        SELECT q.copy_id, q.seq, CASE WHEN x THEN q.bytes ELSE r.told END, CASE WHEN x THEN q.elapsed_ms ELSE r.at END, x FROM
        (SELECT q.*, r.told, r.at, q.moved AND q.bytes > r.told AND (r.told = 0 OR q.bytes - r.told >= 67108864 OR q.elapsed_ms - r.at >= 100) AS x FROM q JOIN r ON q.copy_id = r.copy_id AND q.seq = r.seq + 1) AS q JOIN r ON r.copy_id = q.copy_id AND q.seq = r.seq + 1)
    SELECT q.copy_id, q.seq, q.bytes, q.elapsed_ms FROM q JOIN r ON q.copy_id = r.copy_id AND q.seq = r.seq WHERE r.emit""")
def transferring_events(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    step = F.when(F.col("event_id") % 4 == 0, F.lit(0)).otherwise(F.floor(F.col("value") * 100000))
    rows = X.table(spark, sf, "events").select(
        F.col("user_id").cast("long").alias("copy_id"), F.row_number().over(w).cast("long").alias("seq"), F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("bytes"), F.floor(F.col("event_id") / 8).cast("long").alias("elapsed_ms")
    )
    return control.transferring_events(rows)





@query("""WITH e AS (SELECT user_id AS copy_id, event_id AS seq, CASE WHEN row_number() OVER o = 1 AND user_id % 5 > 0 THEN 1 ELSE 1 + CAST(least(7, (event_id * 7 % 11 + row_number() OVER o) // 9) AS INTEGER) END AS n, event_id * (event_id % 3) AS bytes FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
    p AS (SELECT *, CASE n WHEN 1 THEN 'preparing' WHEN 2 THEN 'started' WHEN 3 THEN 'transferring' WHEN 4 THEN 'flushing' WHEN 5 THEN 'completed' WHEN 6 THEN 'cancelled' WHEN 7 THEN 'failed' ELSE 'lost' END AS phase FROM e),
    w AS (SELECT *, lag(n) OVER o AS bn, lag(bytes) OVER o AS bb FROM p WINDOW o AS (PARTITION BY copy_id ORDER BY seq))
    SELECT copy_id, seq, 'unknown' AS "check" FROM w WHERE n = 8 UNION ALL SELECT copy_id, seq, 'begin' FROM w WHERE bn IS NULL AND n <> 1 UNION ALL SELECT copy_id, seq, 'after the end' FROM w WHERE bn IN (5, 6, 7)
    UNION ALL SELECT copy_id, seq, 'order' FROM w WHERE bn NOT IN (5, 6, 7, 8) AND n < bn UNION ALL SELECT copy_id, seq, 'bytes' FROM w WHERE bytes < bb""")
def copy_lifecycles(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    n = F.when((at == 1) & (F.col("user_id") % 5 > 0), 1).otherwise(1 + F.least(F.lit(7), F.floor((F.col("event_id") * 7 % 11 + at) / 9)).cast("int"))
    names = F.array(*map(F.lit, [*control.PHASES, "lost"]))
    rows = X.table(spark, sf, "events").select(F.col("user_id").alias("copy_id"), F.col("event_id").alias("seq"), F.element_at(names, n.cast("int")).alias("phase"), (F.col("event_id") * (F.col("event_id") % 3)).alias("bytes"))
    return control.phase_violations(rows)


@query("""SELECT 'e' || o_orderkey AS session, o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 11 > 0 AND o_custkey % 9 > 0 AND o_custkey % 4 > 0 AS success FROM orders
    UNION ALL SELECT 'o' || o_orderkey, o_orderkey % 5 > 0 AND o_orderkey % 6 <> 5 AND o_custkey % 9 > 0 AND o_orderkey % 13 > 0 AND (o_orderkey % 2 = 1 OR (o_orderkey % 7 > 0 AND o_custkey % 4 > 0)) FROM orders""")
def session_successes(spark: SparkSession, sf: str) -> DataFrame:
    """Exports, owned transfers and probes with one thing or another gone wrong."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = X.table(spark, sf, "orders")
    none = F.lit(None).cast("string")
    exports = orders.select(
        F.concat(F.lit("e"), k).alias("session"), F.when(k % 5 == 0, "io").alias("primary_error"), none.alias("artifact_cleanup_error"), F.when(k % 7 == 0, "lease").alias("lease_cleanup_error"), none.alias("pagination_cleanup_error"),
        F.when(k % 11 == 0, "aborted").otherwise("completed").alias("lease_cleanup"), F.when(c % 9 == 0, "unknown").otherwise("logged_out").alias("session_cleanup"), F.lit(True).alias("manifest_verified"), (c % 4 > 0).alias("artifact_published"),
    )
    transfer = k % 2 == 0
    end = F.when(transfer, "completed").otherwise("aborted")
    owned = orders.select(
        F.concat(F.lit("o"), k).alias("session"), F.when(transfer, "transfer").otherwise("probe").alias("kind"), F.when(k % 5 == 0, "io").alias("primary_error"), none.alias("journal_error"), none.alias("payload_error"), none.alias("pagination_cleanup_error"),
        end.alias("lease_cleanup"), F.when(k % 6 == 5, "stage_intent").otherwise(F.concat(end, F.lit("_lease"))).alias("state"), F.when(c % 9 == 0, "unknown").otherwise("logged_out").alias("session_cleanup"), (k % 13 == 0).alias("pending"),
        F.when(transfer, c % 4 > 0).alias("manifest_verified"), F.when(transfer, F.lit(True)).alias("container_readback_verified"), F.when(transfer, k).alias("received"), F.when(transfer, k).alias("written"), F.when(transfer, F.when(k % 7 == 0, k - 1).otherwise(k)).alias("durable"),
    )
    return control.export_success(exports).unionByName(control.owned_success(owned))


@query("""WITH r AS (SELECT o_orderkey AS artifact, CASE WHEN o_orderkey % 3 = 0 THEN 'published' ELSE 'publish_intent' END AS state, o_orderkey % 17 = 0 AS pending, o_custkey AS i, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 3 END AS parent FROM orders)
    SELECT artifact, state, pending, CASE WHEN artifact % 5 = 0 THEN 'absent' WHEN artifact % 7 = 0 THEN 'foreign' ELSE 'owned' END AS staged, CASE WHEN artifact % 2 = 0 THEN 'absent' WHEN artifact % 11 = 0 THEN 'foreign' ELSE 'owned' END AS final,
        CASE WHEN parent IS NOT NULL AND artifact % 23 = 0 THEN 'parent' END AS issue FROM r""")
def publication_locations(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = X.table(spark, sf, "orders")
    told = orders.select(k.alias("artifact"), F.when(k % 3 == 0, "published").otherwise("publish_intent").alias("state"), (k % 17 == 0).alias("pending"), c.alias("identity"), (c % 100).alias("operation"), F.when(k % 4 > 0, c % 3).alias("parent"))
    staged = orders.where(k % 5 != 0).select(k.alias("artifact"), F.lit("staged").alias("place"), F.when(k % 7 == 0, c + 1).otherwise(c).alias("identity"), (c % 100).alias("operation"))
    final = orders.where(k % 2 != 0).select(k.alias("artifact"), F.lit("final").alias("place"), c.alias("identity"), F.when(k % 11 == 0, -1).otherwise(c % 100).alias("operation"))
    parents = orders.select(k.alias("artifact"), F.when(k % 23 == 0, 99).otherwise(c % 3).alias("parent"))
    return control.locations(told, staged.unionByName(final), parents)


@query("""SELECT CAST(doc_id AS BIGINT) AS artifact, CASE WHEN doc_id % 7 = 0 THEN 'state' WHEN doc_id % 11 = 0 THEN 'pending' WHEN doc_id % 5 > 0 THEN 'grain' WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN 'content' WHEN doc_id % 19 = 0 THEN 'changed' END AS issue FROM documents""")
def retained_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as artifacts: their journal records, read twice, their compressed grains, and their containers."""
    d = F.col("doc_id")
    docs = X.table(spark, sf, "documents")
    data = F.coalesce("text", F.lit("")).cast("binary")
    told = docs.select(d.alias("artifact"), F.when(d % 7 == 0, "stage_intent").otherwise("completed_lease").alias("state"), (d % 11 == 0).alias("pending"), F.sha2(data, 256).alias("digest"), (F.octet_length(data) + F.when(d % 17 == 0, 1).otherwise(0)).cast("long").alias("container_bytes"))
    again = told.withColumn("pending", F.col("pending") | (F.col("artifact") % 19 == 0))
    grains = inflate_check(spark, sf).select(F.col("index").alias("artifact"), "issue")
    containers = docs.select(d.alias("artifact"), F.sha2(F.when(d % 13 == 0, F.concat(data, F.unhex(F.lit("00")))).otherwise(data), 256).alias("sha256"), F.octet_length(data).cast("long").alias("n_bytes"))
    return control.retained(told, again, grains, containers)


@query("""SELECT CAST(artifact AS BIGINT) AS artifact, CASE WHEN artifact % 3 = 0 THEN 'incomplete' WHEN artifact % 10 = 0 THEN 'missing' WHEN artifact % 7 = 0 OR artifact % 11 = 0 THEN 'content' END AS issue FROM (SELECT doc_id AS artifact FROM documents)""")
def container_issues(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    docs = X.table(spark, sf, "documents")
    data = F.coalesce("text", F.lit("")).cast("binary")
    told = docs.select(d.alias("artifact"), (d % 3 != 0).alias("complete"), (F.octet_length(data) + F.when(d % 7 == 0, 1).otherwise(0)).cast("long").alias("container_bytes"), F.sha2(data, 256).alias("digest"))
    seen = docs.where(d % 10 != 0).select(d.alias("artifact"), F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(F.when(d % 11 == 0, F.unhex(F.lit("00"))).otherwise(data), 256).alias("sha256"))
    return inventory.container_issues(told, seen)


@query("""SELECT doc_id % 30 AS disk_id, CAST(doc_id * 65536 AS BIGINT) AS file_offset, doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 19 <> 0 OR (doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND text IS NULL) AS same FROM documents""")
def fixture_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """The texts' bytes in a fixture, and on a disk in another order, some changed, missing or cut short."""
    d = F.col("doc_id")
    docs = X.table(spark, sf, "documents").select((d % 30).alias("disk_id"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    there = (F.lit(1 << 40) - d) * 65536
    extents = docs.select("disk_id", (d * 65536).alias("file_offset"), there.alias("disk_offset"), F.octet_length("bytes").cast("long").alias("length"))
    fixture = docs.select("disk_id", (d * 65536).alias("start"), "bytes")
    changed = F.when(d % 13 == 0, F.concat("bytes", F.unhex(F.lit("00")))).when((d % 19 == 0) & (F.octet_length("bytes") > 0), F.substring("bytes", F.lit(2), F.octet_length("bytes"))).otherwise(F.col("bytes"))
    disk = docs.where(d % 17 != 0).select("disk_id", there.alias("start"), changed.alias("bytes"))
    return verify.mapped_bytes(extents, fixture, disk)


@query("""SELECT l_orderkey, l_linenumber, list_extract(['pair', 'backend', 'bytes', 'chunk', 'iterations', 'pattern', 'digest', 'oracle', 'wall_ms', 'cpu_ms', 'peak_rss_kib'], CAST(l_orderkey % 12 + 1 AS INTEGER)) AS "check" FROM lineitem WHERE l_orderkey % 12 < 11""")
def evidence_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements of digests, sound but for one field that differs by the order."""
    v = F.col("l_orderkey") % 12
    bad = lambda n, wrong, right: F.when(v == n, wrong).otherwise(right)
    sha = F.sha2(F.col("l_orderkey").cast("string").cast("binary"), 256)
    rows = X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", bad(0, F.lit(3), F.col("l_linenumber") % 3).alias("pair"), bad(1, F.lit("ring2"), F.lit("sha2")).alias("backend"), bad(2, F.lit(0), F.lit(4096)).alias("n_bytes"), F.lit(4096).alias("expected_bytes"),
        bad(3, F.lit(1), F.lit(512)).alias("chunk"), F.lit(512).alias("expected_chunk"), bad(4, F.lit(0), F.lit(9)).alias("iterations"), F.lit(9).alias("expected_iterations"), bad(5, F.lit(True), F.lit(False)).alias("sparse"), F.lit(False).alias("expected_sparse"),
        bad(6, F.upper(sha), sha).alias("sha256"), sha.alias("expected_sha256"), (v != 7).alias("oracle_passed"), bad(8, F.lit(float("nan")), F.col("l_quantity")).alias("wall_ms"), bad(9, F.lit(-1.0), F.col("l_quantity")).alias("cpu_ms"), bad(10, F.lit(0.0), F.col("l_quantity")).alias("peak_rss_kib"),
    )
    return S.evidence_violations(rows, ["l_orderkey", "l_linenumber"], 3, ["sha2", "ring"])


@query("""WITH p AS (SELECT l_suppkey % 7 AS grp, l_partkey % 5 AS run, CASE WHEN l_linenumber % 2 = 0 THEN 'ring' ELSE 'sha2' END AS backend, l_extendedprice / (1 + l_orderkey % 4) AS per FROM lineitem WHERE l_returnflag <> 'R'),
    r AS (SELECT grp, run, backend, median(per) AS m FROM p GROUP BY ALL), s AS (SELECT grp, median(m) FILTER (backend = 'sha2') AS baseline, median(m) FILTER (backend = 'ring') AS candidate FROM r GROUP BY grp)
    SELECT grp, round(baseline, 4) AS baseline, round(candidate, 4) AS candidate, round(100 * (candidate / baseline - 1), 4) AS change_percent FROM s""")
def normalised_medians(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 7).alias("grp"), (F.col("l_partkey") % 5).alias("run"), F.when(F.col("l_linenumber") % 2 == 0, "ring").otherwise("sha2").alias("backend"), F.when(F.col("l_returnflag") == "R", "warm").otherwise("repeat").alias("stage"),
        F.col("l_extendedprice").alias("wall_ms"), (1 + F.col("l_orderkey") % 4).alias("iterations"),
    )
    got = S.normalised_medians(rows, "grp", "run", "backend", "stage", "wall_ms", "iterations", "sha2", "ring")
    return got.select("grp", *[F.round(c, 4).alias(c) for c in ("baseline", "candidate", "change_percent")])


@query("""SELECT o_orderkey AS object_id, 'vm' AS kind, name, CASE name WHEN 'config.name' THEN 'n' || o_custkey ELSE 'off' END AS value, CAST(NULL AS VARCHAR) AS issue FROM orders CROSS JOIN (SELECT unnest(['config.name', 'runtime.powerState']) AS name) AS f WHERE o_orderkey % 9 > 0 AND o_orderkey % 10 > 0
    UNION ALL SELECT o_orderkey, 'vm', NULL, NULL, CASE WHEN o_orderkey % 9 = 0 THEN 'partial' ELSE 'shape' END FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 10 = 0""")
def property_pages(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    one = lambda name, value: F.concat(F.lit(f"<property><name>{name}</name><val>"), value, F.lit("</val></property>"))
    told = F.concat(F.lit("<properties>"), one("config.name", F.concat(F.lit("n"), "o_custkey")), one("config.uuid", F.lit("x")), one("runtime.powerState", F.lit("off")), F.lit("</properties>"))
    body = F.concat(F.lit("<returnval>"), F.when(k % 9 == 0, "<token>t1</token>").otherwise(""), F.when(k % 10 == 0, "").otherwise(told), F.lit("</returnval>"))
    pages = X.table(spark, sf, "orders").select(k.alias("object_id"), F.lit("vm").alias("kind"), body.alias("body"))
    return records.property_pages(pages, {"vm": ["config.name", "runtime.powerState"], "folder": ["name"]})


@query("""WITH d AS (SELECT l_orderkey AS object_id, l_linenumber AS key, l_partkey % 50 AS kib, CASE WHEN l_suppkey % 3 = 0 THEN (l_partkey % 50) * 1024 + CASE WHEN l_suppkey % 5 = 0 THEN 512 WHEN l_suppkey % 7 = 0 THEN 100 WHEN l_suppkey % 11 = 0 THEN 1024 ELSE 0 END END AS b FROM lineitem WHERE l_linenumber % 4 <> 1)
    SELECT object_id, key, CAST(coalesce(b, kib * 1024) AS BIGINT) AS capacity_bytes, CASE WHEN coalesce(b, kib * 1024) = 0 OR coalesce(b, kib * 1024) // 1024 <> kib OR coalesce(b, kib * 1024) % 512 <> 0 THEN 'capacity' END AS issue FROM d""")
def virtual_disks(spark: SparkSession, sf: str) -> DataFrame:
    s, kib = F.col("l_suppkey"), F.col("l_partkey") % 50
    told = F.when(s % 3 == 0, kib * 1024 + F.when(s % 5 == 0, 512).when(s % 7 == 0, 100).when(s % 11 == 0, 1024).otherwise(0))
    kind = F.when(F.col("l_linenumber") % 4 == 1, "VirtualCdrom").otherwise("VirtualDisk")
    return inventory.virtual_disks(X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("key"), kind.alias("type"), kib.alias("capacity_kib"), told.alias("capacity_bytes")))


@query("""SELECT o_orderkey AS id, o_orderkey % 4 > 0 AS written, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey * 512 END AS capacity, CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 3 = 0 THEN sha256(CAST(o_orderkey AS VARCHAR)) END AS digest, CAST(NULL AS VARCHAR) AS issue FROM orders WHERE o_orderkey % 4 > 0
    UNION ALL SELECT o_orderkey, false, NULL, NULL, 'not an object' FROM orders WHERE o_orderkey % 4 = 0""")
def artifact_write(spark: SparkSession, sf: str) -> DataFrame:
    """Artifacts written as JSON and read back; one whose name makes the text too long is not written."""
    k = F.col("o_orderkey")
    rows = X.table(spark, sf, "orders").select(
        k.alias("id"), F.lit(1).alias("schema_version"), F.when(k % 4 == 0, F.repeat(F.lit("x"), 5000)).otherwise(k.cast("string")).alias("artifact"), (k % 3 == 0).alias("complete"), (k * 512).alias("capacity"), k.alias("encoded_bytes"),
        F.when(k % 3 == 0, F.sha2(k.cast("string").cast("binary"), 256)).alias("digest"),
    )
    read = records.artifacts(records.artifact_bodies(rows).select("id", "body"))
    return read.select("id", F.col("body").isNotNull().alias("written"), "capacity", "digest", "issue")


@query("""SELECT o_custkey AS tag, CASE WHEN o_custkey % 5 = 0 THEN 'length' ELSE 'value' END AS issue FROM orders GROUP BY o_custkey HAVING o_custkey % 5 = 0 OR o_custkey % 7 = 0""")
def sample_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark reports, written as versioned JSON texts and read by their schema."""
    runs = X.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("tag")).agg(F.sort_array(F.collect_list("o_totalprice")).alias("times"))
    iters = F.transform("times", lambda x: F.when(F.col("tag") % 7 == 0, F.lit(0.0)).otherwise(F.lit(2.0)))
    told = runs.select("tag", "times", F.when(F.col("tag") % 5 == 0, F.slice(iters, 1, F.size(iters) - 1)).otherwise(iters).alias("iters"))
    read = records.report(told).select(F.from_json("report", "schema_version int, tag bigint, times array<double>, iters array<double>").alias("r")).where("r.schema_version = 1").select("r.tag", "r.times", "r.iters")
    return records.sample_issues(read)


@query("""WITH c AS (SELECT user_id AS run, event_type AS call, count(*) AS calls FROM events GROUP BY ALL), u AS (SELECT DISTINCT user_id AS run FROM events), x AS (SELECT run, 'click' AS call, 12 AS expected FROM u UNION ALL SELECT run, 'view', 13 FROM u UNION ALL SELECT run, 'sync', 0 FROM u)
    SELECT x.run, x.call, coalesce(c.calls, 0) AS calls, CAST(expected AS BIGINT) AS expected FROM x LEFT JOIN c ON c.run = x.run AND c.call = x.call WHERE coalesce(c.calls, 0) <> expected""")
def unexpected_calls(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit(" 12.34    0.000123          12       1 "), "event_type")
    made = records.call_summary(X.table(spark, sf, "events").select(F.col("user_id").alias("run"), line.alias("line")))
    return records.unexpected_calls(made, {"click": 12, "view": 13, "sync": 0})


@query(with_("extents", """, c AS (SELECT disk_id, count(*) AS extents, count(DISTINCT kind) AS kinds, CAST(sum(length) AS BIGINT) AS bytes FROM extents GROUP BY disk_id)
    SELECT disk_id, 'extents' AS "limit", extents AS value FROM c WHERE extents > 12 UNION ALL SELECT disk_id, 'kinds', kinds FROM c WHERE kinds > 2 UNION ALL SELECT disk_id, 'bytes', bytes FROM c WHERE bytes > 300000"""))
def over_limits(spark: SparkSession, sf: str) -> DataFrame:
    got = planning.summary(X.extents(spark, sf)).select("disk_id", F.col("extent_count").alias("extents"), F.col("logical_bytes").alias("bytes"))
    kinds = X.extents(spark, sf).groupBy("disk_id").agg(F.countDistinct("kind").alias("kinds"))
    return control.over_limits(got.join(kinds, "disk_id"), {"extents": 12, "kinds": 2, "bytes": 300000}, "disk_id")


@query("""SELECT s_suppkey AS id, true AS same, upper(s_name) = s_name AS exact, s_acctbal > 0 AS positive, CASE WHEN s_suppkey % 3 = 0 THEN false ELSE s_acctbal > 0 END AS finite FROM supplier""")
def scalar_checks(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(F.col("s_suppkey") % 3 == 0, F.when(F.col("s_suppkey") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("s_acctbal"))
    return X.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), B.same_ascii(F.upper("s_name"), F.lower("s_name")).alias("same"), (F.upper("s_name") == F.col("s_name")).alias("exact"), B.finite_positive(F.col("s_acctbal")).alias("positive"), B.finite_positive(x).alias("finite")
    )
