"""Inventories: traversal, eligibility, exactly-one selections, and admission checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.operators.planning import violations
from blockloom.operators.support import checked_broadcast

# What an exportable disk must be.
FLAT_BACKING = "VirtualDiskFlatVer2BackingInfo"
PERSISTENT = "persistent"
MOST_BYTES = 64 << 40


def walk(edges: DataFrame, roots: DataFrame, most: int = 16) -> DataFrame:
    """(node, level) of all nodes that are reached from ``roots`` (node) along (parent, child), each at its first
    level.  A level is one join; visited nodes are anti-joined, so cycles end; it stops when a level is empty."""
    from blockloom.operators.support import cut

    seen = cut(roots.select("node", F.lit(0).alias("level")).distinct())
    here = seen
    for level in range(1, most + 1):
        step = here.join(edges, here["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct()
        here = cut(step.join(seen, "node", "left_anti").select("node", F.lit(level).alias("level")))
        if here.isEmpty():
            return seen
        seen = cut(seen.unionByName(here))
    raise ValueError(f"the inventory is deeper than {most} levels")


def eligible(vms: DataFrame) -> DataFrame:
    """Virtual machines with exactly one disk that can be exported as it is.

    Rows: label, template, snapshot_present, capacity (asked for) and disks (array of struct).
    """
    d = F.element_at("disks", 1)
    one = F.size("disks") == 1
    fine = (d["capacity_bytes"] == F.col("capacity")) & ~d["encrypted"] & ~d["parent_present"] & (d["disk_mode"] == PERSISTENT) & (d["backing_type"] == FLAT_BACKING)
    return vms.where(~F.col("template") & ~F.col("snapshot_present") & one).where(d["device_key"].isNotNull() & d["backing"].isNotNull() & fine)


def exactly_one(candidates: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, issue): the only candidate, or why there is none."""
    got = candidates.groupBy(key).agg(F.count(value).alias("_n"), F.min(value).alias("_v"))
    issue = F.when(F.col("_n") == 0, "none").when(F.col("_n") > 1, "several")
    return got.select(key, F.when(F.col("_n") == 1, F.col("_v")).alias(value), issue.alias("issue"))


def capacity_bytes(told_bytes: Column, told_kib: Column) -> Column:
    """The capacity from either unit."""
    return F.coalesce(told_bytes, told_kib * 1024)


def admissible_capacity(size: Column) -> Column:
    return (size > 0) & (size <= F.lit(MOST_BYTES)) & (size % 512 == 0)


def safe_name(name: Column) -> Column:
    """Whether a name stays in its folder: relative, no empty, dot or dot-dot part, no backslash, colon or control."""
    plain = ~name.rlike(r"[\\:\x00-\x1F\x7F-\x9F]") & (name != "")
    return plain & F.forall(F.split(name, "/"), lambda p: ~p.isin("", ".", ".."))


def bounded_text(text: Column, most: int) -> Column:
    return (F.octet_length(text) > 0) & (F.octet_length(text) <= most) & ~text.rlike(r"[\x00-\x1F\x7F-\x9F]")


def is_uuid(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def url_issue(url: Column, host: str, port: int) -> Column:
    """Why a data URL is not admitted, or null; the host ``*`` stands for the endpoint's."""
    length = F.octet_length(url)
    url = F.regexp_replace(url, r"^([A-Za-z]+://)\*(?=[:/])", f"$1{host}")
    told = F.try_parse_url(url, F.lit("HOST"))
    at = F.coalesce(F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":([0-9]+)$", 1).try_cast("int"), F.lit(443))
    path = F.try_parse_url(url, F.lit("PATH"))
    return (
        F.when(length > 4096, "length")
        .when(F.try_parse_url(url, F.lit("PROTOCOL")).isNull() | told.isNull(), "shape")
        .when(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) != "https", "scheme")
        .when(F.lower(told) != host, "host")
        .when(at != port, "port")
        .when(F.try_parse_url(url, F.lit("USERINFO")).isNotNull(), "user")
        .when(F.try_parse_url(url, F.lit("REF")).isNotNull(), "fragment")
        .when(~(path.startswith("/nfc/") | path.startswith("/ha-nfc/")), "path")
    )


def select_source(vms: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted_id, issue) for selections bound to an identity: endpoint, reference, UUID in any case, disk key,
    backing, and powered off."""
    w = wanted.select("wanted_id", *[F.col(c).alias(f"_{c}") for c in ("reference", "endpoint", "uuid", "disk_key", "backing")])
    both = w.join(vms, F.col("_reference") == F.col("reference"), "left")
    checks = [
        ("missing", F.col("reference").isNull()),
        ("endpoint", F.col("endpoint") != F.col("_endpoint")),
        ("uuid", F.lower("uuid") != F.lower("_uuid")),
        ("disk key", F.col("disk_key") != F.col("_disk_key")),
        ("backing", F.col("backing") != F.col("_backing")),
        ("powered on", F.col("power_state") != "poweredOff"),
    ]
    return violations(both, ["wanted_id"], [(n, F.coalesce(c, F.lit(False))) for n, c in checks])


def artifact_violations(artifacts: DataFrame) -> DataFrame:
    """(artifact, check): a complete artifact has a digest and an incomplete one none; sizes are admissible."""
    checks = [
        ("digest", F.col("complete") != F.col("digest").isNotNull()),
        ("capacity", ~admissible_capacity(F.col("capacity"))),
        ("digest shape", F.col("digest").isNotNull() & ~F.col("digest").rlike("^[0-9a-f]{64}$")),
    ]
    return violations(artifacts, ["artifact"], [(n, F.coalesce(c, F.lit(False))) for n, c in checks])


def duplicate_properties(properties: DataFrame) -> DataFrame:
    """Properties that an object tells more than once."""
    return properties.groupBy("object_id", "name").agg(F.count("*").alias("n")).where("n > 1")


def missing_properties(properties: DataFrame, required: DataFrame) -> DataFrame:
    """Required (kind, name) that an object of the kind does not tell."""
    objects = properties.select("object_id", "kind").distinct()
    return objects.join(checked_broadcast(required), "kind").join(properties.select("object_id", "name").distinct(), ["object_id", "name"], "left_anti").select("object_id", "name")


def failure_state(published: Column, synced: Column, created: Column, modified: Column) -> Column:
    """What a failed copy leaves behind."""
    return (
        F.when(published & synced, "published")
        .when(published, "published, durability unknown")
        .when(created, "temporary left")
        .when(modified, "destination modified")
        .otherwise("destination unchanged")
    )


def destination_issue(exists: Column, overwrite: Column, regular: Column, alias: Column, size: Column, needed: Column) -> Column:
    """Why a destination is refused, or null."""
    return F.when(~exists, None).when(~overwrite, "exists").when(~regular, "not a regular file").when(alias, "alias of the source").when(size < needed, "too small")


def virtual_disks(devices: DataFrame) -> DataFrame:
    """(object_id, key, capacity_bytes, issue) of the devices that are virtual disks (object_id, key, type,
    capacity_kib, capacity_bytes): the bytes, or the KiB where they are not told; a capacity of zero, one whose units
    contradict each other and one that is not whole sectors are issues."""
    size = capacity_bytes(F.col("capacity_bytes"), F.col("capacity_kib"))
    wrong = (size == 0) | (F.floor(size / 1024) != F.col("capacity_kib")) | (size % 512 != 0)
    disks = devices.where("type = 'VirtualDisk'")
    return disks.select("object_id", "key", size.cast("long").alias("capacity_bytes"), F.when(F.coalesce(wrong, F.lit(True)), "capacity").alias("issue"))


def container_issues(artifacts: DataFrame, containers: DataFrame) -> DataFrame:
    """(artifact, issue): artifacts (artifact, complete, container_bytes, digest) against containers observed afresh
    (artifact, n_bytes, sha256): incomplete ones prove nothing, others must have the same size and digest."""
    seen = containers.select("artifact", F.col("n_bytes").alias("_n"), F.col("sha256").alias("_s"))
    same = (F.col("_n") == F.col("container_bytes")) & (F.col("_s") == F.col("digest"))
    issue = F.when(~F.coalesce("complete", F.lit(False)), "incomplete").when(F.col("_n").isNull(), "missing").when(~F.coalesce(same, F.lit(False)), "content")
    return artifacts.join(seen, "artifact", "left").select("artifact", issue.alias("issue"))
