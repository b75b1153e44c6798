"""Raw images written as blocks: the sink beside ``raw_blocks``."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators.support import cut

#: Bytes of a part: what one task writes.
PART = 64 << 20


def write_raw(blocks: DataFrame, folder: str, part: int = PART) -> DataFrame:
    """Writes blocks (disk_id, start, bytes) and returns the files: disk_id, part, path, n_bytes, sha256.

    A disk is cut into parts of ``part`` bytes, a file each, so a large disk is written by many tasks; a block that
    crosses a cut is split.  In a part bytes go out in order, gaps as zeros; the last part ends with its last block.
    Blocks that overlap raise, and nothing is written twice: a file has a name of its own until it is whole, so a task
    that runs again leaves one file.  Null and empty blocks write nothing.  ``folder`` needs a file system that all
    executors see, with its scheme if it is not the machines' own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import urlparse

        from pyarrow import fs

        scheme = urlparse(folder).scheme
        files, root = (fs.LocalFileSystem(), urlparse(folder).path) if scheme in ("", "file") else fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        now, out, own, at, digest = None, None, "", 0, None

        def close() -> pa.RecordBatch:
            out.close()
            path = f"{root}/{now[0]}-{now[1]:08d}.raw"
            files.move(own, path)
            where = path if scheme in ("", "file") else f"{folder}/{now[0]}-{now[1]:08d}.raw"
            return pa.RecordBatch.from_pylist([{"disk_id": now[0], "part": now[1], "path": where, "n_bytes": at, "sha256": digest.hexdigest()}], schema=schema)

        for batch in batches:
            for disk, number, start, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (disk, number) != now:
                    if out:
                        yield close()
                    now, at, digest, own = (disk, number), 0, hashlib.sha256(), f"{root}/.{uuid.uuid4().hex}"
                    out = files.open_output_stream(own)
                gap = start - at
                if gap < 0:
                    raise ValueError(f"blocks of {disk} overlap at {number * part + start}")
                while gap:
                    zeros = bytes(min(gap, 1 << 20))
                    out.write(zeros)
                    digest.update(zeros)
                    gap -= len(zeros)
                out.write(data)
                digest.update(data)
                at = start + len(data)
        if out:
            yield close()

    schema = pa.schema([("disk_id", pa.string()), ("part", pa.int64()), ("path", pa.string()), ("n_bytes", pa.int64()), ("sha256", pa.string())])
    size = F.octet_length("bytes")
    some = blocks.where(size > 0).select(F.col("disk_id").cast("string").alias("disk_id"), F.col("start").cast("long").alias("at"), "bytes")
    number = F.explode(F.sequence(F.floor(F.col("at") / part), F.floor((F.col("at") + size - 1) / part))).alias("part")
    split = some.select("disk_id", "at", "bytes", number)
    lo = F.greatest(F.col("at"), F.col("part") * part)
    hi = F.least(F.col("at") + size, (F.col("part") + 1) * part)
    piece = F.substring("bytes", (lo - F.col("at") + 1).cast("int"), (hi - lo).cast("int"))
    rows = split.select("disk_id", "part", (lo - F.col("part") * part).alias("start"), piece.alias("bytes"))
    dealt = rows.repartition("disk_id", "part").sortWithinPartitions("disk_id", "part", "start")
    return cut(dealt.mapInArrow(run, "disk_id string, part long, path string, n_bytes long, sha256 string"))
