"""Vectorised word and shingle hashing over Arrow string columns.

A batch of texts is one byte buffer with offsets.  Words are found by a byte
table, and each word's 64-bit hash comes from prefix sums of a polynomial
hash, so the cost is a few array passes per byte and no Python object is made
for a word.  The hash depends only on the word's bytes: it is the same in
every task and every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the temporary arrays (about 60 bytes a byte of text).
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256).astype(np.uint64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: The six white-space bytes 0x09-0x0D and 0x20.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Everything but ASCII letters and digits and the bytes of other letters.
NOT_ALNUM = np.ones(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    NOT_ALNUM[_lo:_hi] = False

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _powers[name] = np.multiply.accumulate(p)
    return _powers[name]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    return h


def chunks(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive runs of whole texts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + size, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray, separators: np.ndarray = WHITE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of each text, and the texts' offsets into them."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(off), np.int64)
    inside = ~separators[buf]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    st, en = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[_LOWER[buf] if lower else buf] * _power("up", _BASE, n + 1)[:n], out=sums[1:])
    return mix((sums[en] - sums[st]) * _power("down", _INVERSE, n + 1)[st]), st, en, np.searchsorted(st, off)


def prefixes(buf: np.ndarray, st: np.ndarray, en: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words are longer than ``length`` bytes, and the hashes of their first ``length`` bytes."""
    n = len(buf)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[_LOWER[buf]] * _power("up", _BASE, n + 1)[:n], out=sums[1:])
    long = np.flatnonzero(en - st > length)
    a = st[long]
    return long, mix((sums[a + length] - sums[a]) * _power("down", _INVERSE, n + 1)[a] + np.uint64(length))


def shingles(word: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, and the texts' offsets; a shorter text with words is one shingle."""
    n = np.diff(off)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_off = np.zeros(len(off), np.int64)
    np.cumsum(count, out=out_off[1:])
    if not out_off[-1]:
        return np.zeros(0, np.uint64), out_off
    run = word[: max(0, len(word) - k + 1)].copy()
    for i in range(1, k):
        run = mix(run * np.uint64(3) + word[i : i + len(run)])
    full = n >= k
    at = np.repeat(off[:-1][full] - out_off[:-1][full], count[full])
    out = np.empty(out_off[-1], np.uint64)
    where = np.repeat(full, count)
    pos = np.flatnonzero(where)
    out[pos] = run[pos + at]
    for d in np.flatnonzero((n > 0) & ~full):
        h = word[off[d] : off[d] + 1].copy()
        for i in range(1, n[d]):
            h = mix(h * np.uint64(3) + word[off[d] + i])
        out[out_off[d]] = mix(h ^ np.uint64(int(n[d])))[0]
    return out, out_off


def distinct(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each segment, and the segments' new offsets.  Sorts ``values`` in place."""
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    starts = off[:-1]
    keep[starts[starts < len(values)]] = True
    new = np.zeros(len(off), np.int64)
    before = np.zeros(len(values) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    new[:] = before[off]
    return values[keep], new


def ragged(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from values and offsets."""
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, type=kind))


def blobs(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary column whose rows are the bytes of the segments."""
    size = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
