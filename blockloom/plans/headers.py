"""Queries over binary headers and tables that are made from the orders, and SQL that decodes the same bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.plans import fixtures as X
from blockloom.plans.registry import query
from blockloom.sources import images

#: Header fields in order, with their bytes.
LAYOUT = [
    ("magic", 4), ("version", 4), ("flags", 4), ("capacity", 8), ("grain", 8), ("descriptor_at", 8), ("descriptor_sectors", 8), ("table_entries", 4), ("redundant_at", 8), ("directory_at", 8), ("overhead", 8), ("unclean", 1),
    ("newlines", 4), ("compression", 2), ("reserved", 1),
]
#: What a field of an order's header is: the sound value, and others by the remainder of the order's key.
SPARSE = {
    "magic": (1447904331, {1: 1}), "version": (1, {2: 2}), "flags": (3, {3: 7, 4: 1, 5: 1}), "capacity": (16384, {6: 100, 7: 0, 22: 1 << 42}), "grain": (128, {8: 100, 9: 0, 23: 1 << 20}), "descriptor_at": (1, {}), "descriptor_sectors": (20, {10: 0}),
    "table_entries": (512, {11: 256}), "redundant_at": (21, {5: 0, 12: 22}), "directory_at": (31, {13: 21, 14: 9999, 15: -1}), "overhead": (128, {16: 0, 17: 100, 18: 1 << 30}), "unclean": (0, {19: 1}),
    "newlines": (0x0A0D200A, {20: 0x0A0A0A0A, 4: 0}), "compression": (0, {21: 1}), "reserved": (0, {24: 9}),
}
STREAM = SPARSE | {
    "version": (3, {2: 1}), "flags": (0x30001, {3: 1, 4: 0x30003, 5: 0x30011, 20: 0x30001}), "compression": (1, {21: 0}), "redundant_at": (0, {}), "directory_at": (-1, {13: 31, 14: 40, 15: 31}), "grain": (128, {8: 64, 9: 0}), "newlines": (0x0A0D200A, {20: 0x0A0A0A0A}),
    "capacity": (16384, {6: 100, 7: 0, 22: 1 << 42}), "overhead": (128, {16: 0, 17: 100, 18: 1 << 30, 12: 2048}),
}
VARIANTS = 25


def _value(told: tuple[int, dict[int, int]], key: str) -> str:
    """The same expression for Spark and DuckDB."""
    plain, others = told
    return f"CASE {key} % {VARIANTS} " + " ".join(f"WHEN {k} THEN {v}" for k, v in others.items()) + f" ELSE {plain} END" if others else str(plain)


def _bytes(value: Column, n: int) -> Column:
    """A number's little-endian bytes in hexadecimal."""
    v = value.cast("long")
    return F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(v, 8 * i).bitwiseAND(F.lit(0xFF))), 2, "0") for i in range(n)])


def _images(spark: SparkSession, sf: str, told: dict) -> DataFrame:
    """id, raw and extent_bytes: a header for each order, every 50th of them cut short."""
    fields = [_bytes(F.expr(_value(told[name], "o_orderkey")), n) for name, n in LAYOUT]
    whole = F.rpad(F.concat(*fields), 1024, "0")
    raw = F.unhex(F.when(F.col("o_orderkey") % 50 == 49, F.substring(whole, 1, 200)).otherwise(whole))
    size = F.when(F.col("o_orderkey") % 27 == 0, 4096).otherwise(1 << 20).cast("long")
    return X.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), raw.alias("raw"), size.alias("extent_bytes"))


def _decoded(told: dict) -> str:
    """SQL: the headers' bytes in hexadecimal (h), and the fields read from them."""
    spelt = " || ".join(f"array_to_string(list_transform(range(0, {n}), lambda i: printf('%02x', (CAST({_value(told[name], 'o_orderkey')} AS BIGINT) >> CAST(8 * i AS INTEGER)) & 255)), '')" for name, n in LAYOUT)
    at, fields = 0, []
    for name, n in LAYOUT:
        u = f"list_sum(list_transform(range(0, {n}), lambda i: CAST('0x' || substr(h, 1 + 2 * CAST({at} + i AS INTEGER), 2) AS HUGEINT) * (CAST(1 AS HUGEINT) << CAST(8 * i AS INTEGER))))"
        fields.append(f"CAST(CASE WHEN {u} >= 9223372036854775808 THEN {u} - 18446744073709551616 ELSE {u} END AS BIGINT) AS {name}")
        at += n
    return f"""WITH w AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey, rpad({spelt}, 1024, '0') AS whole, CASE WHEN o_orderkey % 27 = 0 THEN 4096 ELSE 1048576 END AS extent_bytes FROM orders),
        s AS (SELECT id, extent_bytes, CASE WHEN o_orderkey % 50 = 49 THEN substr(whole, 1, 200) ELSE whole END AS h FROM w), f AS (SELECT id, extent_bytes, length(h) // 2 AS n_bytes, {", ".join(fields)} FROM s)"""


def _checks(rules: list[tuple[str, str]], source: str) -> str:
    told = ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in rules)
    return f""" SELECT id, x AS "check" FROM (SELECT id, unnest([{told}]) AS x FROM {source}) WHERE x IS NOT NULL"""


_SPARSE_MORE = """, e AS (SELECT *, CASE WHEN grain > 0 THEN (CAST(trunc(capacity / grain) AS BIGINT) + 511) // 512 END AS entries FROM f),
    g AS (SELECT *, (entries * 4 + 511) // 512 * 512 AS g_n, descriptor_at * 512 AS d_at, descriptor_sectors * 512 AS d_n, directory_at * 512 AS g_at, redundant_at * 512 AS r_at, overhead * 512 AS over, (flags & 2) <> 0 AS twice, descriptor_at <> 0 AND descriptor_sectors <> 0 AS has_d,
        capacity >= 0 AND capacity < 1099511627776 AND overhead >= 0 AND overhead < 1099511627776 AND descriptor_at >= 0 AND descriptor_at < 1099511627776 AS small,
        capacity >= 0 AND capacity < 1099511627776 AND overhead >= 0 AND overhead < 1099511627776 AND descriptor_at >= 0 AND descriptor_at < 1099511627776 AND grain > 0 AS sound FROM e)"""
_SPARSE_RULES = [
    ("header length", "n_bytes <> 512"), ("magic", "magic <> 1447904331"), ("version", "version <> 1"), ("flags", "(flags & 4294967292) <> 0"), ("compression", "compression <> 0"), ("unclean shutdown", "unclean <> 0"),
    ("newline check", "(flags & 1) <> 0 AND newlines <> 168632330"), ("reserved bytes", "reserved <> 0"), ("grain size", "grain <= 8 OR (grain & (grain - 1)) <> 0"), ("capacity", "capacity = 0 OR grain = 0 OR NOT coalesce(capacity % nullif(grain, 0) = 0, false)"),
    ("table entries", "table_entries <> 512"), ("capacity limit", "NOT small OR capacity * 512 > 1099511627776"), ("grain limit", "grain > 32768"), ("overhead", "overhead = 0 OR NOT coalesce(overhead % nullif(grain, 0) = 0, false)"),
    ("overhead bounds", "NOT small OR over > extent_bytes"), ("descriptor pair", "(descriptor_at <> 0) <> (descriptor_sectors <> 0)"), ("descriptor bounds", "sound AND has_d AND NOT (descriptor_at >= 1 AND d_at + d_n <= over)"),
    ("footer directory", "directory_at = -1"), ("directory bounds", "sound AND directory_at <> -1 AND NOT (directory_at >= 1 AND g_at + g_n <= over)"), ("redundant bounds", "sound AND twice AND NOT (redundant_at >= 1 AND r_at + g_n <= over)"),
    ("redundant without flag", "NOT twice AND redundant_at <> 0"),
    ("overlap", "sound AND ((has_d AND d_at < g_at + g_n AND g_at < d_at + d_n) OR (twice AND ((r_at < g_at + g_n AND g_at < r_at + g_n) OR (has_d AND d_at < r_at + g_n AND r_at < d_at + d_n))))"),
    ("metadata size", "sound AND 512 + CASE WHEN has_d THEN d_n ELSE 0 END + (g_n + entries * 2048) * CASE WHEN twice THEN 2 ELSE 1 END > over"),
]
_STREAM_MORE = """, g AS (SELECT *, capacity * 512 AS c_n, overhead * 512 AS over, capacity > 0 AND capacity < 1099511627776 AND overhead >= 0 AND overhead < 1099511627776 AS sound FROM f)"""
_STREAM_RULES = [
    ("header length", "n_bytes <> 512"), ("magic", "magic <> 1447904331"), ("version", "version <> 3"), ("flags", "(flags & 196608) <> 196608 OR (flags & 4294770684) <> 0"), ("geometry", "grain <> 128 OR table_entries <> 512"), ("compression", "compression <> 1"),
    ("unclean shutdown", "unclean <> 0"), ("newline check", "(flags & 1) <> 0 AND newlines <> 168632330"), ("reserved bytes", "reserved <> 0"), ("extent length", "extent_bytes < 1024 OR extent_bytes % 512 <> 0"), ("capacity", "NOT sound OR c_n % 65536 <> 0"),
    ("overhead", "NOT sound OR overhead = 0 OR over % 65536 <> 0 OR over > extent_bytes"), ("footer profile", "directory_at = -1 AND ((flags & 2) <> 0 OR (sound AND over + 1536 > extent_bytes))"),
]


@query(_decoded(SPARSE) + _SPARSE_MORE + _checks(_SPARSE_RULES, "g"))
def sparse_headers(spark: SparkSession, sf: str) -> DataFrame:
    return images.sparse_header_violations(_images(spark, sf, SPARSE))


@query(_decoded(STREAM) + _STREAM_MORE + _checks(_STREAM_RULES, "g"))
def stream_headers(spark: SparkSession, sf: str) -> DataFrame:
    return images.stream_header_violations(_images(spark, sf, STREAM))


@query("""SELECT CAST(l_suppkey AS VARCHAR) AS id, CAST(l_partkey % 1000 AS BIGINT) AS grain, CAST(128 + min(l_orderkey) AS BIGINT) AS sector FROM lineitem GROUP BY ALL""")
def grain_tables(spark: SparkSession, sf: str) -> DataFrame:
    """An image for each supplier: a header, a directory of two tables, and the suppliers' parts as grains."""
    rows = X.table(spark, sf, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 1000).alias("g")).agg((F.min("l_orderkey") + 128).alias("s"))
    told = rows.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("g", "s"))).alias("m"))
    head = F.concat(*[_bytes(F.lit({"capacity": 128 * 1000, "grain": 128, "directory_at": 21}.get(name, 0)), n) for name, n in LAYOUT])
    tables = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: _bytes(F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0)), 4)), "")
    raw = F.concat(F.rpad(head, 21 * 1024, "0"), F.rpad(F.concat(_bytes(F.lit(22), 4), _bytes(F.lit(26), 4)), 1024, "0"), tables)
    return images.grain_tables(told.select(F.col("l_suppkey").cast("string").alias("id"), F.unhex(raw).alias("raw")))


_ENVELOPE = """WITH k AS (SELECT o_orderkey AS k, o_orderkey % 11 AS v, 65536 * (1 + o_orderkey % 300) AS capacity FROM orders) SELECT CAST(k AS VARCHAR) AS id, CASE v WHEN 1 THEN 'directory place' WHEN 2 THEN 'footer marker' WHEN 3 THEN 'end marker' WHEN 4 THEN 'agreement'
    WHEN 5 THEN 'adjacency' WHEN 6 THEN 'directory marker' ELSE 'length' END AS "check" FROM k WHERE v BETWEEN 1 AND 7"""


@query(_ENVELOPE)
def stream_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """An image's end for each order, some with one thing wrong."""
    k = F.col("o_orderkey")
    v = k % 11
    sectors = 128 * (1 + k % 300)  # capacity in sectors, 1 to 300 grains: one table
    extent = (F.lit(1 << 20) + 512 * (k % 7)).cast("long")
    sound = {"magic": F.lit(images.MAGIC), "version": F.lit(3), "flags": F.lit(0x30001), "capacity": sectors, "grain": F.lit(128), "table_entries": F.lit(512), "overhead": F.lit(128), "newlines": F.lit(0x0A0D200A), "compression": F.lit(1)}

    def head(directory: Column, capacity: Column) -> Column:
        return F.rpad(F.concat(*[_bytes({**sound, "directory_at": directory, "capacity": capacity}.get(name, F.lit(0)), n) for name, n in LAYOUT]), 1024, "0")

    def marker(sectors_: Column, kind: Column) -> Column:
        return F.rpad(F.concat(_bytes(sectors_, 8), _bytes(F.lit(0), 4), _bytes(kind, 4)), 1024, "0")

    at = (extent - images.TAIL_BYTES - 512) / 512 - F.when(v == 5, 1).otherwise(0)
    first = head(F.when(v == 1, 50).otherwise(-1), sectors)
    tail = F.concat(marker(F.lit(1), F.when(v == 2, 2).otherwise(3)), head(at.cast("long"), sectors + F.when(v == 4, 128).otherwise(0)), marker(F.lit(0), F.when(v == 3, 1).otherwise(0)))
    rows = X.table(spark, sf, "orders").select(
        k.cast("string").alias("id"), extent.alias("extent_bytes"), F.unhex(first).alias("head"), F.unhex(F.when(v == 7, F.concat(tail, F.lit("00"))).otherwise(tail)).alias("tail"),
        F.unhex(marker(F.lit(1), F.when(v == 6, 1).otherwise(2))).alias("marker"),
    )
    return images.envelope_violations(rows)
