"""Queries over extent maps, layers, plans and bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators import overlay, planning, ranges, verify
from blockloom.operators.journal import completion, progress
from blockloom.plans import fixtures as X
from blockloom.plans.fixtures import with_
from blockloom.plans.registry import query


@query(with_("extents", """SELECT disk_id, CAST(sum(CASE WHEN kind = 'data' THEN length ELSE 0 END) AS BIGINT) AS data_bytes, CAST(sum(CASE WHEN kind = 'zero' THEN length ELSE 0 END) AS BIGINT) AS zero_bytes,
    CAST(sum(CASE WHEN kind = 'hole' THEN length ELSE 0 END) AS BIGINT) AS hole_bytes, CAST(sum(length) AS BIGINT) AS logical_bytes, count(*) AS extent_count FROM extents GROUP BY disk_id"""))
def plan_summary(spark: SparkSession, sf: str) -> DataFrame:
    return planning.summary(X.extents(spark, sf))


@query(with_("extents", """, m AS (SELECT *, CASE WHEN kind = lag(kind) OVER w AND lag(start + length) OVER w = start THEN 0 ELSE 1 END AS new FROM extents WINDOW w AS (PARTITION BY disk_id ORDER BY start)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY disk_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT disk_id, kind, min(start) AS start, CAST(sum(length) AS BIGINT) AS length, count(*) AS n_extents FROM r GROUP BY disk_id, run, kind"""))
def coalesce_kind(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.coalesce_kind(X.extents(spark, sf)).select("disk_id", "kind", "start", "length", "n_extents")


@query(with_("extents broken", """, w AS (SELECT b.*, s.size, coalesce(lag(b.start + b.length) OVER (PARTITION BY b.disk_id ORDER BY b.start, b.length), 0) AS prev FROM broken b JOIN sizes s USING (disk_id)),
    l AS (SELECT disk_id, max(start + length) AS last FROM broken GROUP BY disk_id)
    SELECT disk_id, 'empty' AS "check", start AS position FROM w WHERE length = 0 UNION ALL SELECT disk_id, 'gap', start FROM w WHERE start > prev
    UNION ALL SELECT disk_id, 'overlap', start FROM w WHERE start < prev UNION ALL SELECT disk_id, 'beyond', start FROM w WHERE start + length > size
    UNION ALL SELECT s.disk_id, 'short', coalesce(l.last, 0) FROM sizes s LEFT JOIN l USING (disk_id) WHERE coalesce(l.last, 0) < s.size"""))
def map_violations(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.map_violations(X.broken(spark, sf), X.sizes(spark, sf))


@query(with_("extents", """, k AS (SELECT disk_id, start, length, kind, unnest(generate_series(0, (length - 1) // 4096)) AS i FROM extents)
    SELECT disk_id, start + i * 4096 AS start, least(4096, length - i * 4096) AS length, CASE kind WHEN 'data' THEN 'copy' WHEN 'zero' THEN 'zero' ELSE 'discard' END AS work FROM k"""))
def work_items(spark: SparkSession, sf: str) -> DataFrame:
    items = ranges.split(X.extents(spark, sf), 4096)
    return items.select("disk_id", "start", "length", planning.work_kind(F.col("kind")).alias("work"))


@query(with_("extents", """SELECT disk_id, greatest(start, size // 4) AS start, least(start + length, size - size // 4) - greatest(start, size // 4) AS length, kind FROM extents JOIN sizes USING (disk_id)
    WHERE greatest(start, size // 4) < least(start + length, size - size // 4)"""))
def clip_range(spark: SparkSession, sf: str) -> DataFrame:
    q = F.floor(F.col("size") / 4)
    asked = X.sizes(spark, sf).select("disk_id", q.alias("from_"), (F.col("size") - q).alias("to_"))
    return ranges.clip(X.extents(spark, sf), asked)


@query(with_("extents", """SELECT disk_id, seq, CASE WHEN start + length > size - 512 THEN 'out_of_bounds' END AS issue FROM extents JOIN sizes USING (disk_id)"""))
def range_bounds(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.extents(spark, sf).join(X.sizes(spark, sf), "disk_id").withColumn("size", F.col("size") - 512)
    return ranges.check_bounds(rows).select("disk_id", "seq", "issue")


@query(with_("extents", """SELECT disk_id, seq FROM extents WHERE start % 4096 <> 0 OR length % 4096 <> 0"""))
def unaligned_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.unaligned(X.extents(spark, sf), 4096).select("disk_id", "seq")


@query(with_("extents broken", """, g AS (SELECT disk_id, start, length, coalesce(lag(start + length) OVER (PARTITION BY disk_id ORDER BY start), 0) AS prev FROM (SELECT disk_id, start, length FROM extents WHERE seq % 101 <> 0)),
    t AS (SELECT disk_id, max(start + length) AS last FROM extents WHERE seq % 101 <> 0 GROUP BY disk_id)
    SELECT disk_id, start, length, kind FROM extents WHERE seq % 101 <> 0 UNION ALL SELECT disk_id, prev, start - prev, 'zero' FROM g WHERE start > prev
    UNION ALL SELECT s.disk_id, coalesce(last, 0), size - coalesce(last, 0), 'zero' FROM sizes s LEFT JOIN t USING (disk_id) WHERE size > coalesce(last, 0)"""))
def gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.fill_gaps(X.extents(spark, sf).where("seq % 101 <> 0"), X.sizes(spark, sf))


@query(with_("extents", """, p AS (SELECT user_id % 1500 AS disk_id, CAST(floor(value * 1000) AS BIGINT) AS point, event_id FROM events)
    SELECT p.disk_id, p.point, e.start, e.length, e.kind FROM (SELECT disk_id, point FROM p) p LEFT JOIN extents e ON e.disk_id = p.disk_id AND e.start <= p.point AND p.point < e.start + e.length"""))
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    points = X.table(spark, sf, "events").select((F.col("user_id") % 1500).alias("disk_id"), F.floor(F.col("value") * 1000).alias("point"))
    return ranges.point_lookup(points, X.extents(spark, sf))


@query(with_("extents", """, q AS (SELECT event_id, user_id AS disk_id, CAST(floor(value * 500) AS BIGINT) AS lo, CAST(floor(value * 500) AS BIGINT) + 20000 AS hi FROM events)
    SELECT q.event_id, e.disk_id, e.start, greatest(e.start, q.lo) AS from_, least(e.start + e.length, q.hi) AS to_ FROM extents e JOIN q ON q.disk_id = e.disk_id AND q.lo < e.start + e.length AND e.start < q.hi"""))
def interval_join_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    lo = F.floor(F.col("value") * 500)
    asked = X.table(spark, sf, "events").select("event_id", F.col("user_id").alias("disk_id"), lo.alias("lo"), (lo + 20000).alias("hi"))
    both = ranges.interval_join(X.extents(spark, sf), asked, 1 << 15)
    return both.select("event_id", "disk_id", "start", F.greatest("start", "lo").alias("from_"), F.least(F.col("start") + F.col("length"), F.col("hi")).alias("to_"))


@query(with_("extents broken", """, r AS (SELECT disk_id, start, length, max(start + length) OVER (PARTITION BY disk_id ORDER BY start, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM broken WHERE length > 0)
    SELECT disk_id, start, length, reached FROM r WHERE reached > start"""))
def region_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.overlapping_regions(X.broken(spark, sf).where("length > 0").select("disk_id", "start", "length"))


@query(with_("extents", """, r AS (SELECT disk_id, start, length, CASE WHEN kind = 'data' THEN CASE WHEN seq % 7 = 0 THEN 'b' ELSE 'a' END END AS backing, CASE WHEN kind = 'data' THEN start + (seq % 3) // 2 * 4096 END AS physical FROM extents),
    m AS (SELECT *, CASE WHEN lag(start + length) OVER w = start AND ((backing IS NULL AND lag(backing) OVER w IS NULL) OR (backing = lag(backing) OVER w AND lag(physical + length) OVER w = physical)) THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY disk_id ORDER BY start)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY disk_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT disk_id, backing, min(start) AS start, CAST(sum(length) AS BIGINT) AS length, min(physical) AS physical, count(*) AS n_runs FROM g GROUP BY disk_id, run, backing"""))
def coalesce_physical(spark: SparkSession, sf: str) -> DataFrame:
    data = F.col("kind") == "data"
    rows = X.extents(spark, sf).select(
        "disk_id", "start", "length", F.when(data, F.when(F.col("seq") % 7 == 0, "b").otherwise("a")).alias("backing"), F.when(data, F.col("start") + F.floor(F.col("seq") % 3 / 2) * 4096).alias("physical")
    )
    return ranges.coalesce_physical(rows).select("disk_id", "backing", "start", "length", "physical", "n_runs")


@query(with_("grains", """SELECT disk_id, grain, min(layer) AS layer, arg_min(sector, layer) AS sector FROM grains GROUP BY disk_id, grain"""))
def overlay_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return overlay.resolve_grains(X.grains(spark, sf))


@query(with_("mixed", """, b AS (SELECT disk_id, start AS pos FROM mixed UNION SELECT disk_id, start + length FROM mixed UNION SELECT disk_id, 0 FROM mixed UNION SELECT disk_id, 593920 FROM mixed),
    a AS (SELECT disk_id, pos AS start, lead(pos) OVER (PARTITION BY disk_id ORDER BY pos) - pos AS length FROM b), k AS (SELECT * FROM a WHERE length IS NOT NULL)
    SELECT k.disk_id, k.start, k.length, min(m.layer) AS layer, arg_min(m.backing_start + k.start - m.start, m.layer) AS backing_start FROM k
    LEFT JOIN mixed m ON m.disk_id = k.disk_id AND m.start <= k.start AND k.start < m.start + m.length GROUP BY k.disk_id, k.start, k.length"""))
def overlay_mixed_grains(spark: SparkSession, sf: str) -> DataFrame:
    return overlay.resolve_mixed(X.mixed_runs(spark, sf), X.mixed_sizes(spark, sf))


@query(with_("grains", """SELECT disk_id, layer, sector, count(*) AS n_grains FROM grains WHERE sector <> 0 GROUP BY ALL HAVING count(*) > 1"""))
def duplicate_sectors(spark: SparkSession, sf: str) -> DataFrame:
    return overlay.duplicate_sectors(X.grains(spark, sf))


@query(with_("extents", """, t AS (SELECT disk_id, seq, length, CAST(sum(length) OVER (PARTITION BY disk_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM extents),
    o AS (SELECT *, row_number() OVER (PARTITION BY disk_id ORDER BY seq) AS n FROM t WHERE total > 150000) SELECT disk_id, seq, total FROM o WHERE n = 1"""))
def budget_first_over(spark: SparkSession, sf: str) -> DataFrame:
    costs = X.extents(spark, sf).select("disk_id", "seq", F.col("length").alias("cost"))
    return overlay.over_budget(costs, 150_000, order="seq").select("disk_id", "seq", "total")


_LAYERS = """c AS (SELECT c_custkey AS d, c_custkey % 17 + 1 AS n FROM customer), i AS (SELECT d, n, unnest(generate_series(1, n)) AS i FROM c),
    l AS (SELECT d AS disk_id, i AS cid, CASE WHEN i < n THEN i + 1 WHEN d % 5 = 0 THEN 999 WHEN d % 7 = 0 THEN 1 END AS parent_cid, CASE WHEN d % 11 = 0 AND i > 2 THEN 1024 ELSE 512 END AS size, i = 1 AS is_leaf FROM i)"""


@query(f"""WITH RECURSIVE {_LAYERS}, w AS (SELECT disk_id, 0 AS depth, cid, parent_cid, CAST(size AS BIGINT) AS size, [cid] AS seen FROM l WHERE is_leaf
    UNION ALL SELECT w.disk_id, w.depth + 1, l.cid, l.parent_cid, CAST(l.size AS BIGINT), list_append(w.seen, l.cid) FROM w JOIN l ON l.disk_id = w.disk_id AND l.cid = w.parent_cid WHERE NOT list_contains(w.seen, l.cid) AND l.size = w.size AND w.depth < 15)
    SELECT w.disk_id, w.depth, w.cid, w.parent_cid, w.size, CASE WHEN w.parent_cid IS NULL THEN NULL WHEN p.cid IS NULL THEN 'missing parent' WHEN list_contains(w.seen, w.parent_cid) THEN 'cycle' WHEN p.size <> w.size THEN 'capacity' WHEN w.depth = 15 THEN 'depth' END AS issue
    FROM w LEFT JOIN l p ON p.disk_id = w.disk_id AND p.cid = w.parent_cid""")
def chain_walk(spark: SparkSession, sf: str) -> DataFrame:
    """A chain of 1 to 17 layers a customer: some end at a missing parent, in a cycle, at another size, or are too long."""
    d, n, i = F.col("disk_id"), F.col("n"), F.col("cid")
    chains = X.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("disk_id"), (F.col("c_custkey") % 17 + 1).cast("long").alias("n"))
    layers = chains.select("disk_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("cid"))
    parent = F.when(i < n, i + 1).when(d % 5 == 0, 999).when(d % 7 == 0, 1).cast("long")
    size = F.when((d % 11 == 0) & (i > 2), 1024).otherwise(512).cast("long")
    return overlay.walk_chain(layers.select("disk_id", "cid", parent.alias("parent_cid"), size.alias("size"), (i == 1).alias("is_leaf")))


@query("""SELECT l_suppkey AS disk_id, l_partkey % 64 AS device, l_orderkey % 8 AS inode, count(*) AS n_layers FROM (SELECT DISTINCT l_suppkey, l_partkey, l_orderkey FROM lineitem) GROUP BY ALL HAVING count(*) > 1""")
def shared_identities(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey").distinct()
    return overlay.shared_identities(rows.select(F.col("l_suppkey").alias("disk_id"), (F.col("l_partkey") % 64).alias("device"), (F.col("l_orderkey") % 8).alias("inode")))


@query("""SELECT kind, caps, CASE WHEN kind = 'data' THEN 'copy' WHEN kind = 'hole' AND (caps & 264) = 264 THEN 'discard' WHEN (caps & 16) = 16 THEN 'zero' ELSE 'write_zeros' END AS operation
    FROM (SELECT unnest(['data', 'zero', 'hole']) AS kind) CROSS JOIN (SELECT unnest(generate_series(0, 511)) AS caps)""")
def op_selection(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.range(512).select(F.explode(F.array(*map(F.lit, ("data", "zero", "hole")))).alias("kind"), F.col("id").alias("caps"))
    return rows.select("kind", "caps", planning.operation(F.col("kind"), F.col("caps")).alias("operation"))


@query(with_("extents", """, b AS (SELECT disk_id, list(start ORDER BY start) AS s, list(length ORDER BY start) AS l, list(CASE kind WHEN 'data' THEN 1 WHEN 'zero' THEN 2 ELSE 3 END ORDER BY start) AS k FROM extents GROUP BY disk_id),
    f AS (SELECT disk_id, flatten(list_transform(range(1, len(s) + 1), lambda i: flatten(list_transform([s[i], l[i], k[i]], lambda v: list_transform(range(0, 8), lambda j: CAST((v >> (8 * j)) & 255 AS HUGEINT)))))) AS bytes FROM b)
    SELECT disk_id, lpad(lower(to_hex(CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, bytes), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS UBIGINT))), 16, '0') AS fingerprint FROM f"""))
def plan_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return planning.fingerprints(X.extents(spark, sf))


@query("""SELECT requested, compatible, issue, CASE WHEN requested = 'threaded' THEN 'threaded' WHEN issue IS NOT NULL THEN CASE WHEN requested = 'auto' THEN 'threaded' END WHEN compatible THEN 'native' WHEN requested = 'auto' THEN 'threaded' END AS selected,
    CASE WHEN requested = 'threaded' THEN 'requested_threaded' WHEN issue IS NOT NULL THEN 'requests_incompatible' WHEN requested = 'native' THEN CASE WHEN compatible THEN 'requested_native' ELSE 'native_unsupported' END
    WHEN compatible THEN 'descriptors_compatible' ELSE 'descriptors_incompatible' END AS reason
    FROM (SELECT unnest(['threaded', 'native', 'auto']) AS requested) CROSS JOIN (SELECT unnest([true, false]) AS compatible) CROSS JOIN (SELECT unnest(['range', NULL]) AS issue)""")
def backend_selection(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(r, c, i) for r in ("threaded", "native", "auto") for c in (True, False) for i in ("range", None)]
    df = spark.createDataFrame(rows, "requested string, compatible boolean, issue string")
    return df.select("*", planning.select_backend(F.col("requested"), F.col("compatible"), F.col("issue")).alias("s")).select("requested", "compatible", "issue", "s.selected", "s.reason")


@query(with_("extents", """, p AS (SELECT disk_id, size, CASE WHEN disk_id % 11 = 0 THEN 0 ELSE 4096 * (1 + disk_id % 3) END AS block, CASE WHEN disk_id % 7 = 0 THEN 768 ELSE 512 END AS sa, 1024 AS da, CASE WHEN disk_id % 13 = 0 THEN 3000 ELSE 512 END AS ba, disk_id % 2 = 0 AS sd, disk_id % 5 = 0 AS dd FROM sizes),
    r AS (SELECT e.disk_id, e.seq, e.start, e.length, p.block, 0 AS n, p.sa AS al FROM extents e JOIN p USING (disk_id) WHERE e.kind = 'data' AND sd UNION ALL SELECT e.disk_id, e.seq, e.start, e.length, p.block, 1, p.da FROM extents e JOIN p USING (disk_id) WHERE e.kind = 'data' AND dd),
    v AS (SELECT disk_id, seq, n, 2 * n + CASE WHEN start % al <> 0 OR length % al <> 0 THEN 0 WHEN length > block AND block % al <> 0 THEN 1 END AS rule FROM r),
    f AS (SELECT disk_id, arg_min(rule, seq * 2 + n) AS rule FROM v WHERE rule IS NOT NULL GROUP BY disk_id)
    SELECT p.disk_id AS plan_id, CASE WHEN block = 0 THEN 'block_size' WHEN sa = 768 THEN 'source_alignment' WHEN ba = 3000 THEN 'buffer_layout' WHEN f.rule = 0 THEN 'source_range' WHEN f.rule = 1 THEN 'source_block' WHEN f.rule = 2 THEN 'destination_range' WHEN f.rule = 3 THEN 'destination_block' END AS issue
    FROM p LEFT JOIN f ON f.disk_id = p.disk_id"""))
def request_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("disk_id")
    plans = X.sizes(spark, sf).select(
        d.alias("plan_id"), F.lit(0).cast("long").alias("start"), F.col("size").alias("length"), F.when(d % 11 == 0, 0).otherwise(4096 * (1 + d % 3)).alias("block"), F.when(d % 7 == 0, 768).otherwise(512).alias("src_align"),
        F.lit(1024).alias("dst_align"), F.when(d % 13 == 0, 3000).otherwise(512).alias("buffer_align"), (d % 2 == 0).alias("src_direct"), (d % 5 == 0).alias("dst_direct"),
    )
    data = X.extents(spark, sf).where("kind = 'data'").select(d.alias("plan_id"), F.col("seq").alias("range_no"), "start", "length")
    return planning.request_issues(plans, data)


@query("""WITH p AS (SELECT o_orderkey AS pair_id, o_orderkey % 8 AS src_caps, o_orderkey % 512 AS dst_caps, 4096 * (1 + o_orderkey % 3) AS src_size, 4096 * (1 + o_orderkey % 5) AS dst_size, o_orderkey % 4096 AS start, 4096 AS length, o_orderkey % 2 = 0 AS flush,
    CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 10 END AS src_identity, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 10 END AS dst_identity FROM orders)
    SELECT pair_id, 'source read' AS "check" FROM p WHERE (src_caps & 1) = 0 UNION ALL SELECT pair_id, 'source bounds' FROM p WHERE start + length > src_size UNION ALL SELECT pair_id, 'destination write' FROM p WHERE (dst_caps & 2) = 0
    UNION ALL SELECT pair_id, 'destination flush' FROM p WHERE flush AND (dst_caps & 4) = 0 UNION ALL SELECT pair_id, 'destination bounds' FROM p WHERE start + length > dst_size UNION ALL SELECT pair_id, 'alias' FROM p WHERE src_identity = dst_identity""")
def copy_preflight(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    pairs = X.table(spark, sf, "orders").select(
        k.alias("pair_id"), (k % 8).alias("src_caps"), (k % 512).alias("dst_caps"), (4096 * (1 + k % 3)).alias("src_size"), (4096 * (1 + k % 5)).alias("dst_size"), (k % 4096).alias("start"), F.lit(4096).cast("long").alias("length"),
        (k % 2 == 0).alias("flush"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 10).alias("src_identity"), F.when(k % 4 > 0, k % 10).alias("dst_identity"),
    )
    return planning.preflight(pairs)


@query(with_("extents", """, p AS (SELECT disk_id, size, CASE WHEN disk_id % 13 = 0 THEN size + 512 ELSE size END AS now, size - disk_id % 2 AS dst, CASE WHEN disk_id % 17 = 0 THEN 8192 ELSE 4096 END AS nb, CASE WHEN disk_id % 19 = 0 THEN 'b' ELSE 'a' END AS nf FROM sizes)
    SELECT disk_id AS plan_id, 'source size' AS "check" FROM p WHERE now <> size UNION ALL SELECT disk_id, 'destination size' FROM p WHERE size > dst UNION ALL SELECT disk_id, 'block size' FROM p WHERE nb <> 4096 UNION ALL SELECT disk_id, 'fingerprint' FROM p WHERE nf <> 'a'"""))
def stale_plans(spark: SparkSession, sf: str) -> DataFrame:
    d, s = F.col("disk_id"), F.col("size")
    plans = X.sizes(spark, sf).select(
        d.alias("plan_id"), s.alias("plan_bytes"), F.when(d % 13 == 0, s + 512).otherwise(s).alias("now_source_bytes"), (s - d % 2).alias("now_destination_bytes"), F.lit(4096).alias("plan_block"), F.when(d % 17 == 0, 8192).otherwise(4096).alias("now_block"),
        F.lit(512).alias("plan_alignment"), F.lit(512).alias("now_alignment"), F.lit("a").alias("plan_fingerprint"), F.when(d % 19 == 0, "b").otherwise("a").alias("now_fingerprint"),
    )
    return planning.stale_plans(plans)


@query(with_("extents", """, n AS (SELECT disk_id, count(*) AS c FROM extents GROUP BY disk_id), m AS (SELECT disk_id, c * 32 + 16 * (65536 + 40) + CASE WHEN disk_id % 4 + 1 > 1 THEN (128 + disk_id % 4 + 1 + 1) * 24 + (disk_id % 4 + 1) * 16 ELSE 0 END AS required FROM n)
    SELECT disk_id, required, required > 1051500 AS over FROM m"""))
def memory_budget(spark: SparkSession, sf: str) -> DataFrame:
    n = X.extents(spark, sf).groupBy("disk_id").agg(F.count("*").alias("c"))
    need = planning.threaded_memory(F.lit(16), F.lit(65536), F.col("disk_id") % 4 + 1, F.lit(128), F.col("c") * 32, 40, 24, 16)
    rows = n.select("disk_id", need.alias("required"), F.lit(1_051_500).alias("budget"))
    over = planning.over_memory(rows).select("disk_id", F.lit(True).alias("over"))
    return rows.join(over, "disk_id", "left").select("disk_id", "required", F.coalesce("over", F.lit(False)).alias("over"))


@query("""SELECT user_id, CAST(sum(event_id) AS BIGINT) AS n_bytes, round(CASE WHEN sum(value) > 0 THEN sum(event_id) / sum(value) ELSE 0 END, 6) AS bytes_per_second, bool_or(event_type = 'error') AS unconfirmed FROM events GROUP BY user_id""")
def copy_totals(spark: SparkSession, sf: str) -> DataFrame:
    t = X.table(spark, sf, "events").groupBy("user_id").agg(F.sum("event_id").alias("n_bytes"), F.sum("value").alias("_s"), F.bool_or(F.col("event_type") == "error").alias("unconfirmed"))
    return t.select("user_id", "n_bytes", F.round(planning.throughput(F.col("n_bytes"), F.col("_s")), 6).alias("bytes_per_second"), "unconfirmed")


@query(with_("extents", """SELECT disk_id, start, round(sum(length) OVER (PARTITION BY disk_id ORDER BY start ROWS UNBOUNDED PRECEDING) / sum(length) OVER (PARTITION BY disk_id), 9) AS fraction FROM extents"""))
def progress_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return completion(X.extents(spark, sf)).select("disk_id", "start", F.round("fraction", 9).alias("fraction"))


@query(with_("extents", """, d AS (SELECT disk_id, row_number() OVER (PARTITION BY disk_id ORDER BY start) AS i, count(*) OVER (PARTITION BY disk_id) AS n, CAST(sum(length) OVER (PARTITION BY disk_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done FROM extents),
    f AS (SELECT disk_id, i, n, done, CASE WHEN done >= 65536 THEN done ELSE 0 END AS last, done >= 65536 OR i = n AS emit FROM d WHERE i = 1
    UNION ALL SELECT d.disk_id, d.i, d.n, d.done, CASE WHEN d.done - f.last >= 65536 THEN d.done ELSE f.last END, d.done - f.last >= 65536 OR d.i = d.n FROM f JOIN d ON d.disk_id = f.disk_id AND d.i = f.i + 1)
    SELECT disk_id, done FROM f WHERE emit"""))
def progress_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return progress(X.extents(spark, sf), 65536)


@query("""SELECT sha256(encode(text)) AS sha256, sha1(encode(text)) AS sha1, count(*) AS n_copies, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_bytes FROM documents GROUP BY ALL HAVING count(*) > 1""")
def content_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return verify.duplicates(verify.digests(X.payloads(spark, sf), "doc_id", "payload"))


@query("""SELECT doc_id, sha256(unhex(array_to_string(list_transform(range(0, 8), lambda j: lpad(to_hex((octet_length(encode(source)) >> (8 * j)) & 255), 2, '0')), '')) || encode(source)
    || unhex(array_to_string(list_transform(range(0, 8), lambda j: lpad(to_hex((octet_length(encode(text)) >> (8 * j)) & 255), 2, '0')), '')) || encode(text)) AS binding FROM documents""")
def binding_digest(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "documents").select("doc_id", verify.length_prefixed(F.col("source"), F.col("text")).alias("binding"))


@query("""WITH f AS (SELECT doc_id AS key, octet_length(encode(text)) AS n, sha256(encode(text)) AS s2, text FROM documents),
    m AS (SELECT doc_id AS key, CASE WHEN doc_id % 50 = 0 THEN octet_length(encode(text)) + 1 ELSE octet_length(encode(text)) END AS size, CASE WHEN doc_id % 7 = 0 THEN 'md5' ELSE 'sha256' END AS kind, CASE WHEN doc_id % 30 = 1 THEN 'XX' ELSE upper(sha256(encode(text))) END AS sum FROM documents)
    SELECT key, CASE WHEN n <> size THEN 'size' WHEN kind = 'md5' THEN 'checksum type' WHEN lower(sum) <> s2 THEN 'checksum' END AS issue FROM m JOIN f USING (key) WHERE n <> size OR kind = 'md5' OR lower(sum) <> s2""")
def manifest_verify(spark: SparkSession, sf: str) -> DataFrame:
    files = verify.digests(X.payloads(spark, sf), "doc_id", "payload").withColumnRenamed("doc_id", "key").withColumn("capacity", F.lit(None).cast("long"))
    k = F.col("key")
    manifest = files.select(
        "key", F.when(k % 50 == 0, F.col("n_bytes") + 1).otherwise(F.col("n_bytes")).alias("size"), "capacity", F.when(k % 7 == 0, "md5").otherwise("sha256").alias("checksum_type"),
        F.when(k % 30 == 1, "XX").otherwise(F.upper("sha256")).alias("checksum"), F.lit(None).cast("string").alias("sha1"),
    )
    return verify.check_manifest(manifest, files)


@query("""WITH c AS (SELECT doc_id % 10 AS disk_id, doc_id * 1048576 AS start, CASE WHEN doc_id % 50 = 0 THEN CASE WHEN length(text) > 40 AND substr(text, 41, 1) <> '~' THEN octet_length(encode(left(text, 40))) END
    WHEN doc_id % 75 = 1 AND length(text) > 10 THEN octet_length(encode(left(text, 10))) END AS pos FROM documents) SELECT disk_id, CAST(min(start + pos) AS BIGINT) AS position FROM c WHERE pos IS NOT NULL GROUP BY disk_id""")
def first_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    d, t = F.col("doc_id"), F.col("text")
    docs = X.table(spark, sf, "documents")
    other = F.when(d % 50 == 0, F.concat(F.substring(t, 1, 40), F.lit("~"), F.expr("substring(text, 42)"))).when(d % 75 == 1, F.substring(t, 1, 10)).otherwise(t)
    blocks = docs.select((d % 10).alias("disk_id"), d.alias("block_no"), (d * 1048576).alias("start"), t.cast("binary").alias("bytes"), other.cast("binary").alias("other"))
    return verify.compare_blocks(blocks.drop("other"), blocks.select("disk_id", "block_no", F.col("other").alias("bytes")))


@query("""SELECT CAST(doc_id % 20 AS VARCHAR) AS disk_id, sha256(encode(string_agg(text, '' ORDER BY doc_id))) AS sha256, count(*) AS n_blocks FROM documents GROUP BY 1""")
def ordered_digest(spark: SparkSession, sf: str) -> DataFrame:
    blocks = X.table(spark, sf, "documents").select((F.col("doc_id") % 20).alias("disk_id"), F.col("doc_id").alias("block_no"), F.col("text").cast("binary").alias("bytes"))
    return verify.ordered_digest(blocks)
