"""Digests, comparisons of bytes, and manifests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def length_prefixed(*parts: Column) -> Column:
    """SHA-256 over each part's length (eight little-endian bytes) and bytes."""

    def size(part: Column) -> Column:
        n = F.octet_length(part).cast("long")
        return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(n, 8 * i).bitwiseAND(F.lit(0xFF))), 2, "0") for i in range(8)]))

    parts = tuple(p.cast("binary") for p in parts)
    return F.sha2(F.concat(*[x for p in parts for x in (size(p), p)]), 256)


def digests(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Both digests and the size of each payload, in one pass over it."""
    data = F.col(payload).cast("binary")
    return rows.select(key, F.sha2(data, 256).alias("sha256"), F.sha1(data).alias("sha1"), F.octet_length(data).cast("long").alias("n_bytes"))


# The least payload with a header, and the header's first bytes.
LEAST_PAYLOAD, MAGIC = 512, "KDMV"


def payload_issue(payload: Column) -> Column:
    """Why a downloaded payload is no image: short (absent is empty), magic (other first bytes), or null."""
    data = F.coalesce(payload.cast("binary"), F.lit("").cast("binary"))
    return F.when(F.octet_length(data) < LEAST_PAYLOAD, "short").when(F.substring(data, 1, len(MAGIC)) != F.lit(MAGIC).cast("binary"), "magic")


def duplicates(digested: DataFrame) -> DataFrame:
    """Digests, both of them, that more than one payload has; absent payloads are equal to each other."""
    return digested.groupBy("sha256", "sha1").agg(F.count("*").alias("n_copies"), F.sum("n_bytes").cast("long").alias("total_bytes")).where("n_copies > 1")


def ordered_digest(blocks: DataFrame, key: str = "disk_id", order: str = "block_no") -> DataFrame:
    """SHA-256 of each disk's blocks in order.

    A digest is sequential, so a disk is one task's work; its blocks are streamed in sorted order and never held
    together.  Blocks of a disk must have distinct numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        now, digest, n = None, None, 0
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest is None or k != now:
                    if digest is not None:
                        yield pa.RecordBatch.from_pydict({"key": [now], "sha256": [digest.hexdigest()], "n_blocks": [n]}, schema=schema)
                    now, digest, n = k, hashlib.sha256(), 0
                digest.update(data.as_buffer() if data.is_valid else b"")
                n += 1
        if digest is not None:
            yield pa.RecordBatch.from_pydict({"key": [now], "sha256": [digest.hexdigest()], "n_blocks": [n]}, schema=schema)

    schema = pa.schema([("key", pa.string()), ("sha256", pa.string()), ("n_blocks", pa.int64())])
    rows = blocks.select(F.col(key).cast("string").alias("key"), F.col("bytes"), order)
    rows = rows.repartition("key").sortWithinPartitions("key", order).select("key", "bytes")
    return rows.mapInArrow(run, "key string, sha256 string, n_blocks long").withColumnRenamed("key", key)


def first_difference(a: Column, b: Column) -> Column:
    """The first byte at which two binaries differ, over the shorter's length; null if none does.

    Halving by comparisons of prefixes: each step is a built-in on the whole value, and their number is the logarithm
    of the length (32 steps cover any value).
    """
    n = F.least(F.octet_length(a), F.octet_length(b))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        same = F.substring(s["a"], F.lit(1), mid + 1) == F.substring(s["b"], F.lit(1), mid + 1)
        go = s["lo"] < s["hi"]
        return F.struct(
            F.when(go & same, mid + 1).otherwise(s["lo"]).cast("int").alias("lo"), F.when(go & ~same, mid).otherwise(s["hi"]).cast("int").alias("hi"), s["a"].alias("a"), s["b"].alias("b")
        )

    start = F.struct(F.lit(0).alias("lo"), n.cast("int").alias("hi"), F.substring(a, F.lit(1), n).alias("a"), F.substring(b, F.lit(1), n).alias("b"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, step, lambda s: s["lo"])
    return F.when(F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n), None).otherwise(found).cast("long")


def compare_blocks(source: DataFrame, destination: DataFrame, keys: tuple[str, ...] = ("disk_id", "block_no")) -> DataFrame:
    """(disk, position) of the first differing byte of each disk; blocks that the destination lacks differ at their
    start, and what the destination has beyond the source is ignored.  Both need a column ``start`` and ``bytes``."""
    both = source.join(destination.select(*keys, F.col("bytes").alias("_other")), list(keys), "left")
    at = F.when(F.col("_other").isNull(), F.lit(0).cast("long")).otherwise(
        F.coalesce(first_difference(F.col("bytes"), F.col("_other")), F.when(F.octet_length("_other") < F.octet_length("bytes"), F.octet_length("_other").cast("long")))
    )
    return both.withColumn("_at", F.col("start") + at).where("_at is not null").groupBy(keys[0]).agg(F.min("_at").alias("position"))


def check_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(key, issue) for manifest entries that their file does not satisfy.

    Entries: key, size, capacity (null: not told), checksum_type and checksum (null: told as sha1).  Files: key,
    n_bytes, capacity, sha256, sha1.
    """
    f = files.select("key", F.col("n_bytes").alias("_n"), F.col("capacity").alias("_c"), F.col("sha256").alias("_256"), F.col("sha1").alias("_1"))
    both = manifest.join(f, "key", "left")
    told = F.lower(F.coalesce("checksum", "sha1"))
    kind = F.when(F.col("checksum").isNull(), "sha1").otherwise(F.col("checksum_type"))
    issue = (
        F.when(F.col("_n").isNull(), "no file")
        .when(F.col("size") != F.col("_n"), "size")
        .when(F.col("capacity").isNotNull() & (F.col("capacity") != F.col("_c")), "capacity")
        .when(~kind.isin("sha256", "sha1") | kind.isNull(), "checksum type")
        .when(told.isNull() | (told != F.when(kind == "sha256", F.col("_256")).otherwise(F.col("_1"))), "checksum")
    )
    return both.select("key", issue.alias("issue")).where("issue is not null")


def mapped_bytes(extents: DataFrame, fixture: DataFrame, disk: DataFrame, key: str = "disk_id") -> DataFrame:
    """(disk_id, file_offset, same): whether each mapped extent's bytes are the same in the fixture and on the disk.

    ``extents``: disk_id, file_offset, disk_offset, length; ``fixture`` and ``disk``: disk_id, start, bytes, blocks of
    the extents' lengths at their offsets.  A block that is missing or shorter is not the same.
    """
    f = fixture.select(key, F.col("start").alias("file_offset"), F.col("bytes").alias("_f"))
    d = disk.select(key, F.col("start").alias("disk_offset"), F.col("bytes").alias("_d"))
    both = extents.join(f, [key, "file_offset"], "left").join(d, [key, "disk_offset"], "left")
    same = (F.octet_length("_f") == F.col("length")) & (F.col("_f") == F.col("_d"))
    return both.select(key, "file_offset", F.coalesce(same, F.lit(False)).alias("same"))
