"""Binary image metadata: headers, grain tables, compressed grains and raw blocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from blockloom.functions.binary import ceil_div, is_multiple, is_power_of_two, little_endian, round_up
from blockloom.operators.planning import violations

# Fixed values of the header: its size, magic, flags, entries of a grain table and their bytes.
HEADER_BYTES = 512
MAGIC = 0x564D444B
NEWLINE, REDUNDANT, COMPRESSED, MARKERS = 1, 2, 1 << 16, 1 << 17
TABLE_ENTRIES, TABLE_BYTES = 512, 2048
STREAM_GRAIN = 65536
LIMITS = {"capacity": 1 << 40, "grain": 16 << 20, "descriptor": 1 << 20, "directory": 1 << 20, "metadata": 256 << 20}


def header_fields(images: DataFrame) -> DataFrame:
    """(id, extent_bytes and the header's fields) from (id, raw, extent_bytes)."""
    raw = F.col("raw")
    at = {
        "magic": (0, 4), "version": (4, 4), "flags": (8, 4), "capacity": (12, 8), "grain": (20, 8), "descriptor_at": (28, 8), "descriptor_sectors": (36, 8), "table_entries": (44, 4),
        "redundant_at": (48, 8), "directory_at": (56, 8), "overhead": (64, 8), "unclean": (72, 1), "compression": (77, 2),
    }
    fields = [little_endian(raw, a, n).alias(name) for name, (a, n) in at.items()]
    check, rest = F.hex(F.substring(raw, 74, 4)), F.hex(F.substring(raw, 80, HEADER_BYTES - 79))
    return images.select("id", "extent_bytes", F.octet_length(raw).alias("n_bytes"), *fields, check.alias("newlines"), rest.rlike("[1-9A-F]").alias("reserved"))


def _overlap(a: Column, n: Column, b: Column, m: Column) -> Column:
    return (a < b + m) & (b < a + n)


def sparse_header_violations(images: DataFrame) -> DataFrame:
    """(id, check) for every rule of the version-1 header that an image breaks."""
    h = header_fields(images)
    c = F.col
    entries = ceil_div(F.try_divide(c("capacity"), c("grain")).cast("long"), TABLE_ENTRIES)
    h = h.withColumn("entries", F.when(c("grain") > 0, entries)).withColumn("directory_bytes", round_up(c("entries") * 4))
    h = h.withColumn("has_redundant", c("flags").bitwiseAND(F.lit(REDUNDANT)) != 0)
    over = c("overhead") * 512
    inside = lambda at, n: (c(at) >= 1) & (c(at) * 512 + n <= over)
    d_at, d_n = c("descriptor_at") * 512, c("descriptor_sectors") * 512
    has_d = (c("descriptor_at") != 0) & (c("descriptor_sectors") != 0)
    g_at, r_at, g_n = c("directory_at") * 512, c("redundant_at") * 512, c("directory_bytes")
    least = 512 + F.when(has_d, d_n).otherwise(0) + (g_n + c("entries") * TABLE_BYTES) * F.when(c("has_redundant"), 2).otherwise(1)
    small = (c("capacity") >= 0) & (c("capacity") < 1 << 40) & (c("overhead") >= 0) & (c("overhead") < 1 << 40) & (c("descriptor_at") >= 0) & (c("descriptor_at") < 1 << 40)
    sound = small & (c("directory_at") < 1 << 40) & (c("redundant_at") < 1 << 40) & (c("descriptor_sectors") < 1 << 40) & (c("grain") > 0)
    checks = [
        ("header length", c("n_bytes") != HEADER_BYTES),
        ("magic", c("magic") != MAGIC),
        ("version", c("version") != 1),
        ("flags", c("flags").bitwiseAND(F.lit(0xFFFFFFFF ^ (NEWLINE | REDUNDANT))) != 0),
        ("compression", c("compression") != 0),
        ("unclean shutdown", c("unclean") != 0),
        ("newline check", (c("flags").bitwiseAND(F.lit(NEWLINE)) != 0) & (c("newlines") != "0A200D0A")),
        ("reserved bytes", c("reserved")),
        ("grain size", (c("grain") <= 8) | ~is_power_of_two(c("grain"))),
        ("capacity", (c("capacity") == 0) | (c("grain") == 0) | ~F.coalesce(F.try_mod(c("capacity"), c("grain")) == 0, F.lit(False))),
        ("table entries", c("table_entries") != TABLE_ENTRIES),
        ("capacity limit", ~small | (c("capacity") * 512 > LIMITS["capacity"])),
        ("grain limit", c("grain") > LIMITS["grain"] // 512),
        ("overhead", (c("overhead") == 0) | ~F.coalesce(F.try_mod(c("overhead"), c("grain")) == 0, F.lit(False))),
        ("overhead bounds", ~small | (over > c("extent_bytes"))),
        ("descriptor pair", (c("descriptor_at") != 0) != (c("descriptor_sectors") != 0)),
        ("descriptor bounds", sound & has_d & ~inside("descriptor_at", d_n)),
        ("footer directory", c("directory_at") == -1),
        ("directory bounds", sound & (c("directory_at") != -1) & ~inside("directory_at", g_n)),
        ("redundant bounds", sound & c("has_redundant") & ~inside("redundant_at", g_n)),
        ("redundant without flag", ~c("has_redundant") & (c("redundant_at") != 0)),
        ("overlap", sound & ((has_d & _overlap(d_at, d_n, g_at, g_n)) | (c("has_redundant") & (_overlap(r_at, g_n, g_at, g_n) | (has_d & _overlap(d_at, d_n, r_at, g_n)))))),
        ("metadata size", sound & (least > over)),
    ]
    return violations(h, ["id"], [(n, F.coalesce(x, F.lit(False))) for n, x in checks])


def stream_header_violations(images: DataFrame) -> DataFrame:
    """(id, check) for every rule of the version-3 stream header that an image breaks."""
    h, c = header_fields(images), F.col
    need = COMPRESSED | MARKERS
    capacity = c("capacity") * 512
    sound = (c("capacity") > 0) & (c("capacity") < 1 << 40) & (c("overhead") >= 0) & (c("overhead") < 1 << 40)
    checks = [
        ("header length", c("n_bytes") != HEADER_BYTES),
        ("magic", c("magic") != MAGIC),
        ("version", c("version") != 3),
        ("flags", (c("flags").bitwiseAND(F.lit(need)) != need) | (c("flags").bitwiseAND(F.lit(0xFFFFFFFF ^ (need | 3))) != 0)),
        ("geometry", (c("grain") != 128) | (c("table_entries") != TABLE_ENTRIES)),
        ("compression", c("compression") != 1),
        ("unclean shutdown", c("unclean") != 0),
        ("newline check", (c("flags").bitwiseAND(F.lit(NEWLINE)) != 0) & (c("newlines") != "0A200D0A")),
        ("reserved bytes", c("reserved")),
        ("extent length", (c("extent_bytes") < 1024) | ~is_multiple(c("extent_bytes"), 512)),
        ("capacity", ~sound | ~is_multiple(capacity, STREAM_GRAIN)),
        ("overhead", ~sound | (c("overhead") == 0) | ~is_multiple(c("overhead") * 512, STREAM_GRAIN) | (c("overhead") * 512 > c("extent_bytes"))),
        ("footer profile", (c("directory_at") == -1) & ((c("flags").bitwiseAND(F.lit(REDUNDANT)) != 0) | (sound & (c("overhead") * 512 + 1536 > c("extent_bytes"))))),
    ]
    return violations(h, ["id"], [(n, F.coalesce(x, F.lit(False))) for n, x in checks])


def grain_tables(images: DataFrame) -> DataFrame:
    """(id, grain, sector) of all allocated grains, from whole images (id, raw): directory entries, then their tables.

    Both levels are explodes of column expressions; an image is one row, so it is bounded by what a row may hold.
    """
    raw = F.col("raw")
    fields = images.select("id", "raw", *[little_endian(raw, a, n).alias(x) for x, a, n in (("capacity", 12, 8), ("grain_sectors", 20, 8), ("directory_at", 56, 8))])
    grains = ceil_div(F.col("capacity"), F.col("grain_sectors"))
    slots = fields.withColumn("grains", grains).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), ceil_div(grains, TABLE_ENTRIES) - 1)))
    table_at = _word(F.col("raw"), F.col("directory_at") * 512 + F.col("slot") * 4)
    tables = slots.select("id", "grains", "slot", F.substring("raw", (table_at * 512 + 1).cast("int"), F.lit(TABLE_BYTES)).alias("table"), table_at.alias("table_at")).where("table_at <> 0")
    each = tables.select("id", "grains", "slot", "table", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TABLE_ENTRIES - 1).cast("long"))).alias("i"))
    found = each.select("id", (F.col("slot") * TABLE_ENTRIES + F.col("i")).alias("grain"), _word(F.col("table"), F.col("i") * 4).alias("sector"), "grains")
    return found.where("sector <> 0 and grain < grains").select("id", "grain", "sector")


def _word(raw: Column, at: Column) -> Column:
    """A little-endian 32-bit number at a computed offset."""
    one = [F.conv(F.hex(F.substring(raw, (at + 1 + i).cast("int"), F.lit(1))), 16, 10).cast("long") for i in range(4)]
    return one[0] + one[1] * (1 << 8) + one[2] * (1 << 16) + one[3] * (1 << 24)


def inflate(grains: DataFrame, size: int = STREAM_GRAIN) -> DataFrame:
    """(disk_id, index, n_bytes, sha256, issue): one whole zlib stream of exactly ``size`` bytes, nothing after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            n, sha, issue = [], [], []
            for payload in batch.column(2).to_pylist():
                d, data, what = zlib.decompressobj(), b"", None
                try:
                    data = d.decompress(payload or b"", size + 1)
                    what = "too long" if len(data) > size else "truncated" if not d.eof else "trailing input" if d.unused_data else "too short" if len(data) < size else None
                except zlib.error:
                    what = "not zlib"
                n.append(len(data) if what is None else None)
                sha.append(hashlib.sha256(data).hexdigest() if what is None else None)
                issue.append(what)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(issue, pa.string())], names=["disk_id", "index", "n_bytes", "sha256", "issue"])

    rows = grains.select(F.col("disk_id").cast("string"), F.col("index").cast("long"), F.col("payload").cast("binary"))
    return rows.mapInArrow(run, "disk_id string, index long, n_bytes long, sha256 string, issue string")


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class RawBlocks(DataSource):
    """``spark.read.format("raw_blocks").option("path", ...)``: a raw image as (disk_id, block_no, start, bytes), a
    partition for each ``partition`` bytes.  Files are opened through a file system that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "raw_blocks"

    def schema(self) -> str:
        return "disk_id string, block_no bigint, start bigint, bytes binary"

    def reader(self, schema):
        return _RawReader(self.options)


class _RawReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.block = options["path"], int(options.get("block", 4096))
        self.step = max(self.block, int(options.get("partition", 64 << 20)) // self.block * self.block)

    def _open(self):
        from urllib.parse import urlparse

        from pyarrow import fs

        scheme = urlparse(self.path).scheme
        files, at = (fs.LocalFileSystem(), urlparse(self.path).path if scheme else self.path) if scheme in ("", "file") else fs.FileSystem.from_uri(self.path)
        return files.open_input_file(at)

    def partitions(self):
        with self._open() as f:
            size = f.size()
        return [_Range(self.path, a, min(size, a + self.step)) for a in range(0, size, self.step)] or [_Range(self.path, 0, 0)]

    def read(self, partition):
        with self._open() as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                data = f.read(min(self.block, partition.end - at))
                if len(data) < min(self.block, partition.end - at):
                    raise OSError(f"{partition.path} ended at {at + len(data)}")
                yield partition.path, at // self.block, at, data
                at += len(data)


def block_kinds(blocks: DataFrame) -> DataFrame:
    """(disk_id, start, length, kind): blocks of zeros are holes, the others data; run islands merge them."""
    zero = ~F.hex("bytes").rlike("[1-9A-F]")
    return blocks.select("disk_id", "start", F.octet_length("bytes").cast("long").alias("length"), F.when(zero, "hole").otherwise("data").alias("kind"))


def discover(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """(disk_id, start, length, kind, issue): what is allocated of each disk, from its blocks (disk_id, start, bytes).

    ``queries``: disk_id, size and size_after (before and after the scan), supported (whether every probe was answered).
    Adjacent blocks of one kind are one extent.  If a probe was not supported the whole disk is one extent of data,
    whatever was found before it; a disk that shrank meanwhile has no extents but one row with the issue ``shrunk``.
    """
    from blockloom.operators.ranges import coalesce_kind

    shrunk = F.col("size_after") < F.col("size")
    found = coalesce_kind(block_kinds(blocks)).select("disk_id", "start", "length", "kind")
    sparse = found.join(queries.where(F.col("supported") & ~shrunk).select("disk_id"), "disk_id").withColumn("issue", F.lit(None).cast("string"))
    dense = queries.where(~F.col("supported") & ~shrunk & (F.col("size") > 0)).select("disk_id", F.lit(0).cast("long").alias("start"), F.col("size").alias("length"), F.lit("data").alias("kind"), F.lit(None).cast("string").alias("issue"))
    failed = queries.where(shrunk).select("disk_id", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("string").alias("kind"), F.lit("shrunk").alias("issue"))
    return sparse.unionByName(dense).unionByName(failed)


#: Bytes of a file's end that a stream image with its directory there has: footer marker, footer, end marker.
TAIL_BYTES = 1536


def envelope_violations(images: DataFrame) -> DataFrame:
    """(id, check) of stream images whose directory is at the end: (id, extent_bytes, head, tail, marker), the first 512
    and last 1536 bytes and the sector before the directory.

    The tail is a footer marker, the footer and an end marker; footer and header agree in all but the directory; the
    directory ends where the tail begins, and its marker tells its size.
    """
    c = F.col
    marker = lambda raw, at: (little_endian(raw, at, 8), little_endian(raw, at + 8, 4), little_endian(raw, at + 12, 4))
    foot, end, before = marker(c("tail"), 0), marker(c("tail"), 1024), marker(c("marker"), 0)
    head, tail = (lambda a, n: F.substring("head", a + 1, n)), (lambda a, n: F.substring("tail", 512 + a + 1, n))
    at, capacity, grain = little_endian(c("tail"), 512 + 56, 8), little_endian(c("head"), 12, 8), little_endian(c("head"), 20, 8)
    tables = ceil_div(F.try_divide(capacity, grain).cast("long"), TABLE_ENTRIES)
    size = round_up(tables * 4)
    # Directory places are at 48 to 63; what is before and after, to the end of the fields, agrees.
    same = (head(0, 48) == tail(0, 48)) & (head(64, 15) == tail(64, 15))
    checks = [
        ("directory place", little_endian(c("head"), 56, 8) != -1),
        ("length", (F.octet_length("head") != HEADER_BYTES) | (F.octet_length("tail") != TAIL_BYTES)),
        ("footer marker", (foot[0] != 1) | (foot[1] != 0) | (foot[2] != 3)),
        ("end marker", (end[0] != 0) | (end[1] != 0) | (end[2] != 0)),
        ("agreement", ~same),
        ("adjacency", at * 512 + size != c("extent_bytes") - TAIL_BYTES),
        ("directory marker", (before[0] * 512 != size) | (before[1] != 0) | (before[2] != 2)),
    ]
    return violations(images, ["id"], [(n, F.coalesce(x, F.lit(True))) for n, x in checks])
