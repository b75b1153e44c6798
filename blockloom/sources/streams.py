"""Stream images: a cursor over the records of a file, and the checks on what it finds."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from blockloom.functions.binary import is_multiple, round_up

# Fixed values of the format: marker types, sectors of a grain, bytes of a grain's record before its data.
MARKERS = {0: "end", 1: "table", 2: "directory", 3: "footer"}
GRAIN_SECTORS = 128
GRAIN_HEAD = 12


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class StreamRecords(DataSource):
    """``spark.read.format("stream_records").option("path", "a,b")``: one row a record of each file (disk_id, record,
    kind, start, length, sector): where it begins and how long it is, a grain's sector and compressed length.

    A record's place is known only from the one before it, so a file is one partition; only its heads are read.
    """

    @classmethod
    def name(cls) -> str:
        return "stream_records"

    def schema(self) -> str:
        return "disk_id string, record bigint, kind string, start bigint, length bigint, sector bigint"

    def reader(self, schema):
        return _Records(self.options)


class _Records(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["path"].split(",") if p]

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        from urllib.parse import urlparse

        from pyarrow import fs

        scheme = urlparse(partition.path).scheme
        files, at = (fs.LocalFileSystem(), urlparse(partition.path).path if scheme else partition.path) if scheme in ("", "file") else fs.FileSystem.from_uri(partition.path)
        with files.open_input_file(at) as f:
            size = f.size()
            head = f.read(512)
            if len(head) < 512:
                raise ValueError(f"{partition.path}: no header")
            pos, n = struct.unpack_from("<Q", head, 64)[0] * 512, 0
            while pos + 512 <= size:
                f.seek(pos)
                sector, length, kind = struct.unpack("<QII", f.read(16))
                if length:
                    yield partition.path, n, "grain", pos, length, sector
                    pos += -(-(GRAIN_HEAD + length) // 512) * 512
                else:
                    yield partition.path, n, MARKERS.get(kind, "unknown"), pos, sector * 512, None
                    pos += 512 + sector * 512
                    if kind == 0:
                        return
                n += 1


def record_ends(records: DataFrame) -> DataFrame:
    """Adds where each record ends."""
    grain = F.col("start") + round_up(F.col("length") + GRAIN_HEAD)
    return records.withColumn("end", F.when(F.col("kind") == "grain", grain).otherwise(F.col("start") + 512 + F.col("length")))


def violations(records: DataFrame) -> DataFrame:
    """(disk_id, record, check): records that don't tile the file, grains out of order, off their place or twice, and
    files that don't end."""
    w = Window.partitionBy("disk_id").orderBy("record")
    grains = F.col("kind") == "grain"
    before = F.max(F.when(grains, F.col("sector"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = record_ends(records).withColumn("_prev", F.lag("end").over(w)).withColumn("_before", before)
    last = F.lead("record").over(w).isNull()
    rows = rows.withColumn("_last", last)
    named = F.array_compact(
        F.array(
            F.when(F.col("_prev").isNotNull() & (F.col("_prev") != F.col("start")), "tiling"),
            F.when(grains & (F.col("sector") == F.col("_before")), "duplicate"),
            F.when(grains & (F.col("sector") < F.col("_before")), "order"),
            F.when(grains & ~is_multiple(F.col("sector"), GRAIN_SECTORS), "place"),
            F.when(F.col("kind") == "unknown", "marker"),
            F.when(F.col("_last") & (F.col("kind") != "end"), "no end"),
        )
    )
    return rows.select("disk_id", "record", F.explode(named).alias("check"))


def largest_record(records: DataFrame) -> DataFrame:
    """The most bytes of a grain's record in each file, 0 without one."""
    most = F.max(F.when(F.col("kind") == "grain", F.col("length") + GRAIN_HEAD))
    return records.groupBy("disk_id").agg(F.coalesce(most, F.lit(0)).cast("long").alias("largest"))


def redundant_tables(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """(disk_id, grain, first, second): grains whose sector differs between a table and its copy, or is in one only."""
    a = primary.select("disk_id", "grain", F.col("sector").alias("first"))
    b = secondary.select("disk_id", "grain", F.col("sector").alias("second"))
    return a.join(b, ["disk_id", "grain"], "full_outer").where("not first <=> second")
