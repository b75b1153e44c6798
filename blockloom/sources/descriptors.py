"""Text descriptors of disk images, parsed by column expressions: one row a line, then tokens, then checks.

A descriptor has a header (key=value), extent lines (access, sectors, type, file, offset) and a data base section
(ddb.key="value"), in this order.  A line's problem is the first rule that it breaks; a descriptor's, that of its first
line with one, or a missing field (line 0).  Variants: ``flat`` (FLAT and ZERO extents), ``sparse``, ``chain`` (sparse
with a parent) and ``stream`` (one SPARSE extent, another type name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the format.
DDB_KEYS = ["ddb.adaptertype", "ddb.geometry.cylinders", "ddb.geometry.heads", "ddb.geometry.sectors", "ddb.virtualhwversion", "ddb.toolsversion", "ddb.uuid", "ddb.longcontentid"]
CREATE_TYPES = {
    "flat": {"monolithicflat": "monolithicFlat", "twogbmaxextentflat": "twoGbMaxExtentFlat", "2gbmaxextentflat": "twoGbMaxExtentFlat", "custom": "custom"},
    "sparse": {"monolithicsparse": "monolithicSparse", "twogbmaxextentsparse": "twoGbMaxExtentSparse", "2gbmaxextentsparse": "twoGbMaxExtentSparse"},
    "stream": {"streamoptimized": "streamOptimized"},
}
NO_PARENT = 0xFFFFFFFF
SPLIT_BYTES = 2 << 30
MOST = {"descriptor": 1 << 20, "line": 8192, "extents": 1024, "metadata": 128, "name": 4096}

_TOKEN = r'"[^"]*"|=|[^ \t="#]+'
_COMMENT = r'^((?:[^"#]|"[^"]*")*)#.*$'


def trimmed(body: Column) -> Column:
    """The text without its trailing NUL padding."""
    return F.regexp_replace(body, r"\x00+$", "")


def lines(descriptors: DataFrame) -> DataFrame:
    """(descriptor_id, line, raw, tokens): from (descriptor_id, body)."""
    rows = descriptors.select("descriptor_id", F.posexplode(F.split(trimmed(F.col("body")), "\n")).alias("_i", "raw"))
    rows = rows.select("descriptor_id", (F.col("_i") + 1).alias("line"), F.regexp_replace("raw", "\r$", "").alias("raw"))
    bare = F.trim(F.regexp_replace(F.col("raw"), _COMMENT, "$1"), F.lit(" \t"))
    return rows.withColumn("text", bare).withColumn("tokens", F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)))


def _quoted(token: Column) -> Column:
    return token.startswith('"')


def _unquoted(token: Column) -> Column:
    return F.when(_quoted(token), F.substring(token, F.lit(2), F.length(token) - 2))


def parsed_lines(descriptors: DataFrame, variant: str = "flat") -> DataFrame:
    """One row a line that is not blank: what it is (header, extent, ddb), its fields, and its issue."""
    t = [F.get("tokens", F.lit(i)) for i in range(6)]
    rows = lines(descriptors).where(F.size("tokens") > 0)
    is_pair = (F.size("tokens") == 3) & (t[1] == "=") & ~_quoted(t[0])
    key = F.lower(t[0])
    part = F.when(is_pair & key.startswith("ddb."), "ddb").when(is_pair, "header").otherwise("extent")
    rows = rows.withColumn("part", part).withColumn("key", F.when(is_pair, key)).withColumn("value", F.when(is_pair, F.coalesce(_unquoted(t[2]), t[2]))).withColumn("is_quoted", is_pair & _quoted(t[2]))
    rows = rows.select(
        "*",
        F.when(part == "extent", F.upper(t[0])).alias("access"),
        F.when((part == "extent") & t[1].rlike("^[0-9]+$"), t[1].try_cast("long")).alias("sectors"),
        F.when(part == "extent", F.upper(t[2])).alias("type"),
        F.when(part == "extent", _unquoted(t[3])).alias("file_name"),
        F.when((part == "extent") & t[4].rlike("^[0-9]+$"), t[4].try_cast("long")).alias("backing_sector"),
        F.size("tokens").alias("n_tokens"),
    )
    before = Window.partitionBy("descriptor_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.when(F.col("part") == "header", 0).when(F.col("part") == "extent", 1).otherwise(2)
    rows = rows.withColumn("_rank", rank).withColumn("_reached", F.coalesce(F.max("_rank").over(before), F.lit(0)))
    same_key = Window.partitionBy("descriptor_id", "part", "key").orderBy("line")
    rows = rows.withColumn("_again", F.col("key").isNotNull() & (F.row_number().over(same_key) > 1))
    sparse = variant != "flat"
    family = "stream" if variant == "stream" else "sparse" if sparse else "flat"
    types = list(CREATE_TYPES[family])
    ddb = DDB_KEYS + (["ddb.toolsinstalltype"] if variant == "stream" else [])
    cid_shape = "^[0-9a-fA-F]{1,8}$" if sparse else "^[0-9a-fA-F]{8}$"
    v, k = F.col("value"), F.col("key")
    header = (
        F.when(F.col("_reached") > 0, "late header")
        .when(~k.isin("version", "cid", "parentcid", "createtype", "encoding", "parentfilenamehint"), "unknown key")
        .when((k == "parentfilenamehint") & F.lit(variant != "chain"), "unwanted parent")
        .when(k.isin("version", "cid", "parentcid") & F.col("is_quoted"), "quoting")
        .when(k.isin("createtype", "encoding", "parentfilenamehint") & ~F.col("is_quoted"), "quoting")
        .when((k == "version") & ~v.rlike("^[0-9]+$"), "number")
        .when((k == "version") & (v.try_cast("long") != 1), "unknown version")
        .when(k.isin("cid", "parentcid") & ~v.rlike(cid_shape), "number")
        .when((k == "parentcid") & F.lit(variant != "chain") & (F.lower(F.lpad(v, 8, "0")) != "ffffffff"), "unwanted parent")
        .when((k == "createtype") & ~F.lower(v).isin(*types), "layout name")
        .when((k == "encoding") & (F.upper(v) != "UTF-8"), "encoding")
        .when((k == "parentfilenamehint") & (v == ""), "blank hint")
        .when(F.col("_again"), "duplicate")
    )
    data_base = (
        F.when(F.col("_reached") == 0, "early ddb").when(~k.isin(*ddb), "ddb name").when(~F.col("is_quoted"), "bare ddb").when(F.col("_again"), "duplicate")
    )
    kinds = ["SPARSE"] if sparse else ["FLAT", "ZERO"]
    n, kind = F.col("n_tokens"), F.col("type")
    extent = (
        F.when(F.col("_reached") == 2, "late extent")
        .when(n < 3, "field count")
        .when(~F.col("access").isin("RW", "RDONLY"), "access mode")
        .when(F.col("sectors").isNull(), "number")
        .when(F.try_multiply("sectors", F.lit(512)).isNull(), "overflow")
        .when(F.col("sectors") == 0, "empty extent")
        .when(~kind.isin(*kinds), "extent kind")
        .when((kind == "ZERO") & (n != 3), "field count")
        .when((kind == "SPARSE") & ((n != 4) | F.col("file_name").isNull()), "field count")
        .when((kind == "FLAT") & ((n != 5) | F.col("file_name").isNull()), "field count")
        .when((kind == "FLAT") & F.col("backing_sector").isNull(), "number")
        .when(F.col("file_name") == "", "blank file")
        .when(F.octet_length("file_name") > MOST["name"], "file bytes")
    )
    issue = (
        F.when(F.octet_length("raw") > MOST["line"], "line bytes")
        .when(F.regexp_replace("raw", "\t", "").rlike(r"[\x00-\x1F\x7F-\x9F]"), "encoding")
        .when(F.length(F.regexp_replace("text", '[^"]', "")) % 2 == 1, "unterminated quote")
        .when(F.col("text").rlike(r'[^ \t="]"[^"]*"') & ~F.col("text").rlike(r'^(?:"[^"]*"|[^"])*$'), "glued tokens")
        .when(n > 6, "token count")
        .when(F.col("part") == "header", header)
        .when(F.col("part") == "ddb", data_base)
        .otherwise(extent)
    )
    return rows.withColumn("issue", issue).drop("_rank", "_reached", "_again")


def extents(descriptors: DataFrame, variant: str = "flat") -> DataFrame:
    """(descriptor_id, position, access, start, length, type, file_name, backing_start) of the extent lines."""
    rows = parsed_lines(descriptors, variant).where("part = 'extent' and issue is null")
    w = Window.partitionBy("descriptor_id").orderBy("line")
    size = F.col("sectors") * 512
    start = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return rows.select(
        "descriptor_id", (F.row_number().over(w) - 1).alias("position"), "access", start.alias("start"), size.alias("length"), "type", "file_name", (F.col("backing_sector") * 512).alias("backing_start")
    )


def violations(descriptors: DataFrame, variant: str = "flat") -> DataFrame:
    """(descriptor_id, line, issue): the first problem of each descriptor that has one."""
    rows = parsed_lines(descriptors, variant)
    broken = rows.where("issue is not null").select("descriptor_id", "line", "issue")
    family = "stream" if variant == "stream" else "sparse" if variant != "flat" else "flat"
    known = CREATE_TYPES[family]
    by_line = Window.partitionBy("descriptor_id").orderBy("line")
    named = F.create_map(*[F.lit(x) for p in known.items() for x in p])
    kind = F.last(F.when(F.col("key") == "createtype", named[F.lower("value")]), ignorenulls=True).over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    nth = F.sum((F.col("part") == "extent").cast("int")).over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    laid = rows.withColumn("_kind", kind).withColumn("_nth", nth).where("part = 'extent' and issue is null")
    single = F.col("_kind").isin("monolithicFlat", "monolithicSparse", "streamOptimized")
    layout = (
        F.when(F.col("_kind").isNull(), "create type before extents")
        .when(F.col("_kind").isin("monolithicFlat", "twoGbMaxExtentFlat") & ((F.col("type") != "FLAT") | (F.col("backing_sector") != 0)), "flat at offset zero")
        .when(single & (F.col("_nth") > 1), "one extent")
        .when(F.col("_kind").isin("twoGbMaxExtentFlat", "twoGbMaxExtentSparse") & (F.col("sectors") * 512 > SPLIT_BYTES), "split extent exceeds 2 GiB")
        .when(F.col("_nth") > MOST["extents"], "extents")
    )
    broken = broken.unionByName(laid.select("descriptor_id", "line", layout.alias("issue")).where("issue is not null"))
    per = rows.groupBy("descriptor_id").agg(F.collect_set("key").alias("_keys"), F.max((F.col("part") == "extent").cast("int")).alias("_extents"), F.max(F.when(F.col("key") == "parentcid", F.lower("value"))).alias("_parent"))
    everyone = descriptors.select("descriptor_id").join(per, "descriptor_id", "left")
    has = lambda k: F.coalesce(F.array_contains("_keys", k), F.lit(False))
    based = F.lpad(F.col("_parent"), 8, "0") == "ffffffff"
    whole = (
        F.when(~has("version"), "missing version")
        .when(~has("parentcid"), "missing parent cid")
        .when(F.coalesce(based, F.lit(False)) & has("parentfilenamehint"), "base has parent hint")
        .when(~F.coalesce(based, F.lit(True)) & ~has("parentfilenamehint"), "missing parent hint")
        .when(~has("cid"), "missing cid")
        .when(~has("createtype"), "missing create type")
        .when(F.coalesce("_extents", F.lit(0)) == 0, "missing extents")
    )
    # A missing field is found at the end, so a line's problem comes first.
    missing = everyone.select("descriptor_id", F.lit(1 << 30).alias("line"), whole.alias("issue")).where("issue is not null")
    first = broken.unionByName(missing).groupBy("descriptor_id").agg(F.min(F.struct("line", "issue")).alias("_f"))
    return first.select("descriptor_id", F.when(F.col("_f.line") == 1 << 30, 0).otherwise(F.col("_f.line")).alias("line"), "_f.issue")


def backings(extent_rows: DataFrame) -> DataFrame:
    """(descriptor_id, file_name, first_position, required_bytes): each backing file once."""
    named = extent_rows.where("file_name is not null")
    return named.groupBy("descriptor_id", "file_name").agg(F.min("position").alias("first_position"), F.max(F.coalesce("backing_start", F.lit(0)) + F.col("length")).cast("long").alias("required_bytes"))


def same_mapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Descriptors whose ordered extents differ between two sources, with the side that has the row alone."""
    columns = ["descriptor_id", "position", "access", "start", "length", "type"]
    left, right = a.select(*columns), b.select(*columns)
    return left.exceptAll(right).withColumn("side", F.lit("a")).unionByName(right.exceptAll(left).withColumn("side", F.lit("b")))


def with_fallback(descriptors: DataFrame) -> DataFrame:
    """(descriptor_id, variant, line, issue): flat if it parses, else sparse; if both fail, flat's problem."""
    flat, sparse = violations(descriptors, "flat"), violations(descriptors, "sparse").withColumnRenamed("line", "_l").withColumnRenamed("issue", "_i")
    both = descriptors.select("descriptor_id").join(flat, "descriptor_id", "left").join(sparse, "descriptor_id", "left")
    variant = F.when(F.col("issue").isNull(), "flat").when(F.col("_i").isNull(), "sparse")
    return both.select("descriptor_id", variant.alias("variant"), F.when(variant.isNull(), F.col("line")).alias("line"), F.when(variant.isNull(), F.col("issue")).alias("issue"))
