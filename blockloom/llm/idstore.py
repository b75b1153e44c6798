"""Token ids in independent zstandard frames with a trailing seek table.

A file is a row of zstandard frames, each of whole documents' ids (little-endian unsigned 32-bit) up to about
``FRAME_BYTES``, then one frame with the documents' ids, lengths and whether the id is null, then a skippable frame with the seek table of the
public zstandard seekable format: for each frame its compressed and decompressed size and a checksum (the low 32 bits
of XXH64 of its content).  Any zstandard tool can decompress the file; a reader of some documents reads the seek table
and the last frame and decompresses only the frames that hold them, checking each.

Documents are dealt out by ranges of their id, so files and rows are in ascending order: null ids first, equal ids by a
hash of the text, then by the text.  If an id has more than ``HOT`` rows, the ranges go by id, hash and place in the
table, so that no file must hold all rows of one id.  A path without a scheme belongs to the cluster's default file
system, which all executors see.  A file is written under a name of its own and then renamed: a task that runs twice leaves one file.
Null text is empty and has the end id only; repeated rows are stored as often as they occur; empty tables give none.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, compress
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.cluster import cut, shared_folder, tidy

FRAME_BYTES = 256 << 10
#: Words held by a worker's table of encoded words; a full table is emptied.
WORDS_HELD = 800_000
#: Pieces held by its table of pieces, likewise.
PIECES_HELD = 500_000
#: New words that are cut into pieces together.
TOGETHER = 100_000
#: Rows of one id that one file may have to hold.
HOT = 10_000
#: Bytes of text whose new words are looked up together.
TEXT_BYTES = 8 << 20

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

#: Words of printable ASCII and composed Latin letters, which the normaliser only lowers.
_SIMPLE = re.compile("[!-~À-ÖØ-öø-įı-ſ]*").fullmatch


def _store(path: str):
    """The file system of a path that every executor sees, and the path in it."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path if path.startswith("file:") else path
    return fs.FileSystem.from_uri(path)


class Writer:
    """Writes one file; ``add`` documents in order, then ``close``."""

    def __init__(self, path: str, level: int = 1):
        self._fs, self.path = _store(path)
        self._own = f"{os.path.dirname(self.path)}/.{os.path.basename(self.path)}.{uuid.uuid4().hex}"
        self._fs.create_dir(os.path.dirname(self.path), recursive=True)
        self._out = self._fs.open_output_stream(self._own)
        self._zip = zstandard.ZstdCompressor(level=level)
        self._held: list[bytes] = []
        self._size = 0
        self._table: list[tuple[int, int, int]] = []
        self._ids: list[int] = []
        self._lengths: list[int] = []
        self._null: list[bool] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._ids.append(0 if doc_id is None else doc_id)
        self._null.append(doc_id is None)
        self._lengths.append(len(ids) // 4)
        self._held.append(ids)
        self._size += len(ids)
        if self._size >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        self._frame(b"".join(self._held))
        self._held, self._size = [], 0

    def _frame(self, data: bytes) -> None:
        packed = self._zip.compress(data)
        self._out.write(packed)
        self._table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> int:
        """Writes index and seek table and gives the file its name; returns the number of ids in it."""
        if self._held:
            self._flush()
        self._frame(np.array([self._ids, self._lengths, self._null], "<i8").tobytes())
        table = b"".join(struct.pack("<III", *row) for row in self._table)
        table += struct.pack("<IBI", len(self._table), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self._out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self._out.close()
        self._fs.move(self._own, self.path)
        return sum(self._lengths)


class Reader:
    """Reads one file; only the frames that are asked for are read and decompressed."""

    def __init__(self, path: str):
        files, at = _store(path)
        self._in = files.open_input_file(at)
        size = self._in.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9)) if size >= 17 else (0, 0, 0)
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError(f"{path}: no seek table")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self._packed, self._plain, self._sum = (table[:, i].astype(np.int64) for i in range(3))
        self._offset = np.concatenate(([0], np.cumsum(self._packed)))
        self._zip = zstandard.ZstdDecompressor()
        self.doc_ids, self.lengths, null = np.frombuffer(self.frame(n - 1), "<i8").reshape(3, -1)
        self.null = null != 0
        self._frame_start = np.concatenate(([0], np.cumsum(self._plain[: n - 1])))
        self._doc_start = np.concatenate(([0], np.cumsum(self.lengths * 4)))
        self.frames = n - 1
        self.frames_read = 0

    def _at(self, offset: int, size: int) -> bytes:
        self._in.seek(offset)
        return self._in.read(size)

    def frame(self, i: int) -> bytes:
        data = self._zip.decompress(self._at(int(self._offset[i]), int(self._packed[i])), max_output_size=int(self._plain[i]))
        if len(data) != self._plain[i] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self._sum[i]:
            raise ValueError(f"frame {i} is damaged")
        return data

    def read(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(place in the file, bytes of the ids) of all documents, or of those with the wanted ids."""
        places = range(len(self.doc_ids)) if wanted is None else np.flatnonzero(np.isin(self.doc_ids, list(wanted)) & ~self.null).tolist()
        held, data = -1, b""
        for p in places:
            start, end = int(self._doc_start[p]), int(self._doc_start[p + 1])
            f = int(np.searchsorted(self._frame_start, start, side="right")) - 1
            if f != held and end > start:
                held, data = f, self.frame(f)
                self.frames_read += 1
            yield p, data[start - self._frame_start[f] : end - self._frame_start[f]] if end > start else b""

    def close(self) -> None:
        self._in.close()


class _Words(dict):
    """Raw word -> bytes of its ids, as the library encodes it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.of.no_truncation()
        self.of.no_padding()
        self.of.encode_special_tokens = False
        vocab = self.of.get_vocab(with_added_tokens=False)
        told = json.loads(self.of.to_str())
        suffix = told["model"].get("end_of_word_suffix") or ""
        if not suffix:
            raise ValueError("the vocabulary does not mark the ends of words")
        self.ends = np.zeros(max(self.of.get_vocab().values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.split = _splitter(told)
        added = [re.escape(x["content"]) for x in told["added_tokens"]]
        self.added = re.compile("|".join(added), re.IGNORECASE).search if added else lambda _: None
        #: Piece -> bytes of its ids.
        self.pieces: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Encodes new words in a few calls: white space separates words here, so each keeps its own ids.

        Words of simple letters are put together from their pieces, of which there are far fewer; a piece ends with a
        token that ends a word, so the pieces' ids are told apart by these tokens, other words' ids by the places that
        the library tells.
        """
        plain = [bool(self.split and _SIMPLE(w)) and not self.added(w) for w in words]
        low = "\n".join(compress(words, plain)).lower().split("\n")
        parts = [self.split(t) for t in low] if any(plain) else []
        self._learn_pieces(parts)
        get = self.pieces.__getitem__
        self.update(zip(compress(words, plain), [get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for p in parts], strict=True))
        other = [w for w, p in zip(words, plain, strict=True) if not p]
        for i in range(0, len(other), 20_000):
            some = other[i : i + 20_000]
            start = np.cumsum([0, *(len(t) + 1 for t in some)])
            found = self.of.encode(" ".join(some), add_special_tokens=False)
            owner = np.searchsorted(start, np.array([a for a, _ in found.offsets], np.int64), side="right") - 1
            self.update(zip(some, _dealt(len(some), found.ids, np.searchsorted(owner, np.arange(len(some) + 1))), strict=True))

    def _learn_pieces(self, parts: list[list[str]]) -> None:
        new = set(chain.from_iterable(parts)).difference(self.pieces)
        if len(self.pieces) + len(new) > PIECES_HELD:
            self.pieces.clear()
            new = set(chain.from_iterable(parts))
        new = list(new)
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            ids = self.of.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids
            self.pieces.update(zip(some, _dealt(len(some), ids, np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))), strict=True))


def _splitter(told: dict) -> Callable[[str], list[str]] | None:
    """Cuts a lowered simple word into the pieces that the file's pattern makes of it; none if the file's normaliser
    or pattern are of another kind."""
    normal = told["normalizer"] or {}
    for x in normal.get("normalizers", [normal]):
        if x.get("type") not in ("NFC", "Lowercase") and not (x.get("type") == "Replace" and x["pattern"] == {"Regex": "\\s+"}):
            return None
    before = told["pre_tokenizer"] or {}
    steps = before.get("pretokenizers", [before])
    if [x.get("type") for x in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"] or steps[0]["behavior"] != "Removed" or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
        return None
    letters = "a-zß-öø-ÿĀ-ſ"
    pattern = steps[0]["pattern"].get("Regex", "")
    for theirs, ours in ((r"[^\s\p{L}\p{N}]+", f"[^\\s{letters}0-9]+"), (r"[\p{L}]+", f"[{letters}]+"), (r"[\p{N}]", "[0-9]")):
        if pattern.count(theirs) != 1:
            return None
        pattern = pattern.replace(theirs, ours)
    # What is left besides must be plain: the endings after an apostrophe.
    rest = pattern.replace(f"[^\\s{letters}0-9]+", "").replace(f"[{letters}]+", "").replace("[0-9]", "")
    lowers = any(x.get("type") == "Lowercase" for x in normal.get("normalizers", [normal]))
    return re.compile(pattern).findall if lowers and re.fullmatch("['a-z|]*", rest) else None


def _dealt(n: int, ids: list[int], at: np.ndarray) -> list[bytes]:
    """The ids of each of ``n`` words, which begin at the places ``at``, as bytes."""
    if len(at) != n + 1 or at[-1] != len(ids):
        raise ValueError("words and ids do not match")
    data, at = np.array(ids, "<u4").tobytes(), (4 * at).tolist()
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def encoded(texts: list[bytes | None], path: str, end_id: int) -> Iterator[bytes]:
    """The ids of each text and the end id, as bytes."""
    table, end = _words(path), struct.pack("<I", end_id)

    def flush(held: list[bytes]) -> Iterator[bytes]:
        # Each distinct word is looked up once; Arrow finds them and puts their ids in all their places.
        split = pc.ascii_split_whitespace(pa.array(held, pa.large_binary()).view(pa.large_string()))
        words = split.values.dictionary_encode()
        if not len(words):
            yield from [end] * len(held)
            return
        # Joined, for one string leaves Arrow far faster than many.
        whole = pa.LargeListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int64()), words.dictionary)
        distinct = pc.binary_join(whole, pa.scalar("\n", pa.large_string()))[0].as_py().split("\n")
        new = [w for w in distinct if w not in table]
        if len(table) + len(new) > WORDS_HELD:
            table.clear()
            new = distinct
        for i in range(0, len(new), TOGETHER):
            table.learn(new[i : i + TOGETHER])
        _, offsets, data = pa.array(list(map(table.__getitem__, distinct)), pa.large_binary()).take(words.indices).buffers()
        at = np.frombuffer(offsets, "<i8", len(words) + 1)[split.offsets.to_numpy()].tolist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield data[a:b].to_pybytes() + end

    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append(t or b"")
        size += len(t or b"")
        if size >= TEXT_BYTES:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents' ids in ascending order of their id.  Returns the files: part, path, docs, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or Writer(f"{folder}/part-{part:06d}.ids.zst")
            ids = batch.column(0).to_pylist()
            n += len(ids)
            texts = [t.as_py() for t in batch.column(1).cast(pa.binary())]
            for i, data in zip(ids, encoded(texts, tokenizer, end_id), strict=True):
                out.add(i, data)
        if out:
            tokens = out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/part-{part:06d}.ids.zst"], "docs": [n], "tokens": [tokens]})

    folder = qualified(docs.sparkSession, folder)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    hot = not rows.groupBy("id").count().where(F.col("count") > HOT).isEmpty()
    if hot:
        ranged = rows.withColumn("h", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id()).repartitionByRange("id", "h", "place")
    else:
        ranged = rows.repartitionByRange("id").withColumn("h", F.xxhash64("text"))
    ranged = ranged.sortWithinPartitions("id", "h", "text").select("id", "text")
    return cut(ranged.mapInArrow(tidy(run), "part long, path string, docs long, tokens long"))


def read(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files alone: id, start (ids of all documents before it), n_tokens and the CRC-32 of its
    ids.  ``files`` has a row a file; their running sum is the only thing computed in one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = Reader(path)
                crc = [zlib.crc32(data) for _, data in file.read()]
                ids = pa.array(file.doc_ids, mask=file.null)
                begin = start + np.concatenate(([0], np.cumsum(file.lengths)))[:-1]
                yield pa.RecordBatch.from_arrays([ids, pa.array(begin), pa.array(file.lengths), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])
                file.close()

    n = files.count()
    placed = files.selectExpr("part", "path", "coalesce(sum(tokens) over (order by part rows between unbounded preceding and 1 preceding), 0) as start")
    # A file a task, by ranges: parts are distinct, and a task without a file costs as much Python as one with a small file.
    placed = placed.repartitionByRange(max(1, n), "part").select("path", "start")
    return placed.mapInArrow(tidy(run), "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: one without belongs to the cluster's default file system, not to a machine's disk."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def new_folder(docs: DataFrame) -> str:
    """A fresh folder for files in the cluster's shared folder."""
    return f"{shared_folder(docs.sparkSession).rstrip('/')}/ids-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of files."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
