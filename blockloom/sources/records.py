"""Text, JSON and XML records: artifacts, journals, inventories, benchmark runs, fuzz logs and call summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.binary import finite_positive

ARTIFACT = "schema_version int, artifact string, complete boolean, capacity bigint, encoded_bytes bigint, digest string"
RUNS = "benchmark string, variant string, pair int, tag string, times array<double>, iters array<double>, median double"
MOST_ARTIFACT_BYTES = 4096

OBJECT = "id string, kind string, name string, capacity bigint, free bigint, template boolean, children struct<child: array<string>>"


def artifacts(rows: DataFrame) -> DataFrame:
    """Closed records of version 1 from JSON text (body): the fields and ``issue``."""
    parsed = F.from_json("body", ARTIFACT)
    known = [x.split()[0] for x in ARTIFACT.split(", ")]
    keys = F.json_object_keys("body")
    issue = (
        F.when(F.octet_length("body") > MOST_ARTIFACT_BYTES, "size")
        .when(keys.isNull(), "not an object")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, known)))) > 0, "unknown field")
        .when(F.size(F.array_except(F.array(*[F.lit(k) for k in known if k != "digest"]), keys)) > 0, "missing field")
        .when(~F.coalesce(parsed["schema_version"] == 1, F.lit(False)), "version")
    )
    return rows.select("*", parsed.alias("_p")).select(*rows.columns, "_p.*", issue.alias("issue"))


def journal_envelopes(rows: DataFrame) -> DataFrame:
    """Adds whether the checksum beside a record's raw text (record, checksum) is right; the text is never rewritten."""
    return rows.withColumn("intact", F.sha2("record", 256) == F.col("checksum"))


def objects(rows: DataFrame) -> DataFrame:
    """Inventory objects from XML text (body), one element a row; a body that does not fit gives nulls."""
    return rows.select("*", F.from_xml("body", OBJECT).alias("o")).select(*rows.columns, "o.*")


def object_edges(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("id").alias("parent"), F.explode("children.child").alias("child"))


def runs(spark, path: str) -> DataFrame:
    """Benchmark runs from JSON files with the known schema; a file that does not fit fails."""
    return spark.read.schema(RUNS).option("multiLine", True).option("mode", "FAILFAST").json(path)


def fuzz_progress(rows: DataFrame) -> DataFrame:
    """(target, executions, event, coverage, features, rate, rss_mb) from log lines (target, line)."""
    shape = r"^#(\d+)\s+(\w+)\s+cov: (\d+) ft: (\d+).* exec/s: (\d+) rss: (\d+)Mb"
    at = [F.regexp_extract("line", shape, i) for i in range(1, 7)]
    return rows.where(F.col("line").rlike(shape)).select(
        "target", at[0].cast("long").alias("executions"), at[1].alias("event"), at[2].cast("long").alias("coverage"), at[3].cast("long").alias("features"), at[4].cast("long").alias("rate"), at[5].cast("long").alias("rss_mb")
    )


def call_summary(rows: DataFrame) -> DataFrame:
    """(run, call, calls, errors) from call summary lines: share, seconds, per call, calls, [errors,] name."""
    t = F.split(F.trim("line"), r"\s+")
    n = F.size(t)
    body = rows.where(F.trim(F.col("line")).rlike(r"^[0-9.]+\s+[0-9.]+\s+[0-9]+\s+[0-9]+\s+([0-9]+\s+)?[a-z_0-9]+$"))
    return body.select("run", F.element_at(t, -1).alias("call"), F.get(t, F.lit(3)).cast("long").alias("calls"), F.when(n == 6, F.get(t, F.lit(4)).cast("long")).otherwise(F.lit(0).cast("long")).alias("errors"))


def report(rows: DataFrame, version: int = 1) -> DataFrame:
    """One JSON text a row, with a version."""
    return rows.select(F.to_json(F.struct(F.lit(version).alias("schema_version"), *rows.columns)).alias("report"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose stamp (size, modified) changed between two listings, or that are gone."""
    now = after.select("path", F.col("size").alias("_s"), F.col("modified").alias("_m"))
    both = before.join(now, "path", "left")
    return both.where(F.col("_s").isNull() | (F.col("_s") != F.col("size")) | (F.col("_m") != F.col("modified"))).select("path", F.col("_s").isNull().alias("gone"))


CONFIG = (
    "schema_version int, endpoint string, certificate_sha256 string, pin_provenance string, "
    "selection struct<vm_reference: string, bios_uuid: string, disk_key: bigint, backing: string, logical_bytes: bigint>, "
    "store string, destination string, artifact_id string, output_id string, timeout_seconds bigint"
)
_CONFIG_FIELDS = ["schema_version", "endpoint", "certificate_sha256", "pin_provenance", "selection", "store", "destination", "artifact_id", "output_id", "timeout_seconds"]


def recovery_configs(rows: DataFrame) -> DataFrame:
    """Closed recovery configurations of version 1 from JSON text (body): the fields, the default timeout filled in, and
    ``issue``."""
    p = F.from_json("body", CONFIG)
    keys = F.json_object_keys("body")
    told = F.array(*map(F.lit, _CONFIG_FIELDS))
    issue = (
        F.when(keys.isNull(), "not an object")
        .when(F.size(F.array_except(keys, told)) > 0, "unknown field")
        .when(F.size(F.array_except(F.array(*map(F.lit, _CONFIG_FIELDS[:-1])), keys)) > 0, "missing field")
        .when(~F.coalesce(p["schema_version"] == 1, F.lit(False)), "version")
        .when(~p["artifact_id"].rlike("^[0-9a-fA-F]{32}$") | ~p["output_id"].rlike("^[0-9a-fA-F]{32}$"), "id")
    )
    full = rows.select("*", p.alias("_p"), issue.alias("issue")).select(*rows.columns, "_p.*", "issue")
    return full.withColumn("timeout_seconds", F.coalesce("timeout_seconds", F.when(F.col("issue").isNull(), F.lit(3600).cast("long"))))


def path_reports(rows: DataFrame) -> DataFrame:
    """(display, bytes_hex) of paths as bytes (path): bytes that are no UTF-8 are shown replaced, and in hexadecimal."""
    valid = F.is_valid_utf8(F.col("path").cast("string"))
    return rows.select("*", F.make_valid_utf8(F.col("path").cast("string")).alias("display"), F.when(~valid, F.lower(F.hex("path"))).alias("bytes_hex"))


def artifact_bodies(rows: DataFrame) -> DataFrame:
    """Adds the JSON text (body) of artifacts by the closed schema, absent digests left out; a text that is too long is
    null: it must not be written."""
    fields = [x.split()[0] for x in ARTIFACT.split(", ")]
    body = F.to_json(F.struct(*[F.col(f) for f in fields]))
    return rows.withColumn("body", F.when(F.octet_length(body) <= MOST_ARTIFACT_BYTES, body))


def sample_issues(runs_: DataFrame) -> DataFrame:
    """(tag, issue) for runs whose times and iterations are not arrays of one length, not empty, finite and positive."""
    fine = lambda a: F.forall(a, lambda x: x.isNotNull() & finite_positive(x))
    issue = (
        F.when(F.coalesce(F.size("times") != F.size("iters"), F.lit(True)) | (F.size("times") < 1), "length")
        .when(~fine(F.col("times")) | ~fine(F.col("iters")), "value")
    )
    return runs_.select("tag", issue.alias("issue")).where("issue is not null")


def unexpected_calls(summary: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(run, call, calls, expected) where a run made a call more or less often than asserted; calls that are not asserted
    may be any number, asserted calls that are missing were made 0 times."""
    wanted = F.explode(F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v).cast("long"))]))
    asked = summary.select("run").distinct().select("run", wanted.alias("call", "expected"))
    made = summary.groupBy("run", "call").agg(F.sum("calls").alias("calls"))
    return asked.join(made, ["run", "call"], "left").select("run", "call", F.coalesce("calls", F.lit(0)).cast("long").alias("calls"), "expected").where("calls <> expected")


def property_pages(pages: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """(object_id, kind, name, value, issue) of retrieved pages (object_id, kind, body): the properties that are asked for
    of the kind.  A page with a continuation token is part of an answer and gives one row with the issue ``partial``
    and no property, one without a result ``shape``."""
    told = "token string, properties struct<property: array<struct<name: string, val: string>>>"
    p = F.from_xml("body", told)
    issue = F.when(F.coalesce(p["token"], F.lit("")) != "", "partial").when(p["properties"].isNull(), "shape")
    asked = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("kind")]
    wanted = F.filter(p["properties"]["property"], lambda x: F.array_contains(asked, x["name"]))
    none = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("val")))
    rows = pages.select("object_id", "kind", issue.alias("issue"), F.explode(F.when(issue.isNull(), wanted).otherwise(none)).alias("_p"))
    return rows.select("object_id", "kind", "_p.name", F.col("_p.val").alias("value"), "issue")
