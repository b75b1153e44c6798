"""Language identification by rank-order profiles.

A text's n-grams of one to ``LONGEST`` letters (lower-cased; a word's edges count as a letter) are ranked by frequency,
ties by code points.  Each language has a profile, the ranking of its training texts.  A text's distance to a language
is the sum over its ``RANKS`` most frequent n-grams of how far out of place each is in the profile, ``RANKS`` if it is
not there; the nearest language wins, ties by name.

Profiles are learnt from at most about ``TRAINED`` texts a language, drawn by a hash of their id among the rows that
may be learnt from; prediction uses nothing but the text, all of it.

A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was learnt.  The score is
1 - distance / largest possible distance.  Rows with a null id are predicted and never learnt from; repeated rows are
returned as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm import text as T
from blockloom.llm.cluster import checked_broadcast, cut, tidy

RANKS = 400
LONGEST = 3
TRAINED = 3_000
_EDGE = (1 << 21) - 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, 0 if it is none."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x323B0):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _symbols(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the texts with one edge between words and at both ends of a text; offsets of the texts."""
    raw = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    # Offsets in code points: bytes that do not continue a character.
    starts = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    at = starts[off]
    code = _letters()[raw]
    # A slot before each text and one at the very end hold edges.
    n_docs = len(off) - 1
    spread = np.zeros(len(code) + n_docs + 1, np.uint32)
    spread[np.arange(len(code)) + np.repeat(np.arange(1, n_docs + 1), np.diff(at))] = code
    keep = np.ones(len(spread), bool)
    keep[1:] = (spread[1:] != 0) | (spread[:-1] != 0)
    head = at + np.arange(n_docs + 1)
    keep[head] = True
    new = np.concatenate(([0], np.cumsum(keep)))[head]
    out = spread[keep]
    out[out == 0] = _EDGE
    return out, new


def _ngrams(letters: np.ndarray) -> np.ndarray:
    """The n-grams of one text's letters (with edges) as numbers; a number tells its length."""
    s = letters.astype(np.uint64)
    one = s[s != _EDGE]
    if not len(one):
        return one
    two = (s[:-1] << np.uint64(21)) | s[1:]
    two = two[(s[:-1] != _EDGE) | (s[1:] != _EDGE)]
    three = (s[:-2] << np.uint64(42)) | (s[1:-1] << np.uint64(21)) | s[2:]
    three = three[s[1:-1] != _EDGE]
    return np.concatenate((one, two, three))


def _ranked(grams: np.ndarray, ranks: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams in order, and their counts."""
    grams.sort()
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    n = np.diff(np.append(first, len(grams)))
    if len(n) > ranks:
        least = np.partition(n, len(n) - ranks)[len(n) - ranks]
        some = np.flatnonzero(n >= least)
        some = some[np.argsort(-n[some], kind="stable")][:ranks]
    else:
        some = np.argsort(-n, kind="stable")
    return grams[first[some]], n[some]


class Profiles:
    """The learnt rankings: ``distances`` of a text's ranking to each language."""

    def __init__(self, ranked: dict[str, np.ndarray], ranks: int = RANKS):
        self.names, self.ranks = sorted(ranked), ranks
        self.grams = np.unique(np.concatenate([ranked[x] for x in self.names])) if ranked else np.zeros(0, np.uint64)
        self.rank = np.full((len(self.names), len(self.grams)), -1, np.int64)
        for i, x in enumerate(self.names):
            self.rank[i, np.searchsorted(self.grams, ranked[x])] = np.arange(len(ranked[x]))

    def distances(self, top: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        known = np.flatnonzero(self.grams[at] == top)
        rank = self.rank[:, at[known]]
        apart = np.where(rank >= 0, np.minimum(np.abs(rank - known), self.ranks), self.ranks)
        return apart.sum(axis=1) + (len(top) - len(known)) * self.ranks

    def predict(self, letters: np.ndarray) -> tuple[str, float]:
        grams = _ngrams(letters)
        if not len(grams) or not self.names:
            return "und", 0.0
        top, _ = _ranked(grams, self.ranks)
        d = self.distances(top)
        best = int(np.argmin(d))
        return self.names[best], float(1 - d[best] / (len(top) * self.ranks))


def held_out(id_col: str):
    """Rows that are never learnt from."""
    return F.coalesce(F.expr(f"crc32(cast(`{id_col}` as string)) % 3 = 1"), F.lit(True))


def learn(docs: DataFrame, may_learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", trained: int = TRAINED) -> Profiles:
    """Profiles from rows where ``may_learn`` holds and the language is not null."""
    rows = docs.where(may_learn).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and id is not null")
    size = cut(rows.groupBy(F.col("lang").alias("_l")).agg(F.count("*").alias("_n")))
    if size.isEmpty():
        return Profiles({})
    share = F.least(F.lit(1.0), F.lit(trained) / F.col("_n")) * (1 << 20)
    sample = rows.join(checked_broadcast(size), F.col("lang") == F.col("_l")).where(F.expr("pmod(xxhash64(id, 29L), 1048576)") < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold(lang: str) -> None:
            g = [(x, np.ones(len(x), np.int64)) for x in held.pop(lang, [])] + ([total[lang]] if lang in total else [])
            keys, where = np.unique(np.concatenate([a for a, _ in g]), return_inverse=True)
            total[lang] = keys, np.bincount(where, np.concatenate([b for _, b in g])).astype(np.int64)

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, hi, buf, off in T.chunks(batch.column(1)):
                s, at = _symbols(buf, off)
                for d in range(hi - lo):
                    held.setdefault(langs[lo + d], []).append(_ngrams(s[at[d] : at[d + 1] + 1]))
                for lang in list(held):
                    fold(lang)
        for lang, (keys, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= RANKS)
    grams: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():
        grams.setdefault(r["lang"], []).append(r["gram"])
    return Profiles({lang: np.array(g, np.uint64) for lang, g in grams.items()})


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, names, scores in _predictions(batch, 1, profiles):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, profiles: Profiles, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows whose language is known with at least this score, with all their columns, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index(text_col)
            for lo, hi, names, scores in _predictions(batch, column, profiles):
                kept = [x != "und" and s >= least_score for x, s in zip(names, scores, strict=True)]
                yield batch.slice(lo, hi - lo).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def _predictions(batch: pa.RecordBatch, column: int, profiles: Profiles) -> Iterator[tuple[int, int, list[str], list[float]]]:
    for lo, hi, buf, off in T.chunks(batch.column(column)):
        s, at = _symbols(buf, off)
        found = [profiles.predict(s[at[d] : at[d + 1] + 1]) for d in range(hi - lo)]
        yield lo, hi, [x for x, _ in found], [y for _, y in found]
