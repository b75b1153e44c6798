"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = 1 / (1 + exp(theta_k - w.x)): all thresholds share the weights w, so the grades are ordered by one
score, and the expected severity is the sum of these probabilities over k.

Features are words (runs of letters and digits, lower-cased) and their first ``PREFIXES`` bytes, which stand for the
stem of inflected words; a feature's value is log(1 + occurrences in the whole text).  The labels only say toxic or
not, so the grades are learnt from held-out agreement: the labelled rows are dealt into ``GRADES`` parts, a model of two
levels is fitted on each, and a toxic row gets grade 1 and one more for each model of another part, which has not seen
it, that calls it toxic.  Grade 0 is not toxic.  Grades that no row gets are left out.

The model is fitted on at most about ``LABELLED`` labelled rows, drawn by a hash of their id; features must mark toxic
text beyond chance (likelihood ratio of at least ``LEAST_RATIO``), and the ``FEATURES`` strongest are used.  Scoring
reads every whole text.

Null and empty texts have no features and get the model's lowest severity; without any marked feature (no labels, one
class only) every severity is 0.  Labels with a null id or grade, and labels of unknown documents, are ignored; a
label that repeats counts once, and a document labelled both ways counts as both.  Of a repeated id the smallest text is
learnt from.  Repeated rows are returned as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import text as T
from blockloom.llm.cluster import checked_broadcast, cut, tidy

LABELLED = 20_000
FEATURES = 1_000
LEAST_RATIO = 30.0
PREFIXES = (4, 5, 6, 7, 8)
GRADES = 3
#: A text is toxic from this P(grade >= 1); unmarked text is at about a hundredth.
REJECT_AT = 0.2


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the thresholds of grades 1 and up."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each score and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def _features(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, end row, [(row of each occurrence, feature)]) chunk by chunk."""
    for lo, hi, buf, off in T.chunks(pc.utf8_lower(batch.column(column))):
        word, st, en, word_off = T.words(buf, off, T.NOT_ALNUM)
        row = np.repeat(np.arange(hi - lo), np.diff(word_off))
        found = [(row, word)]
        for n in PREFIXES:
            long, h = T.prefixes(buf, st, en, n)
            found.append((row[long], h))
        yield lo, hi, found


def _per_document(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """The distinct features of each document with any."""
    row = np.concatenate([r for r, _ in found])
    h = np.concatenate([x for _, x in found])
    order = np.argsort(row, kind="stable")
    row, h = row[order], h[order]
    for a, b in zip(*(lambda c: (c[:-1], c[1:]))(np.flatnonzero(np.diff(row, prepend=-1, append=1 << 60)).tolist()), strict=True):
        yield np.unique(h[a:b])


def _counted(labelled: DataFrame, among: np.ndarray | None) -> DataFrame:
    """In how many documents each feature (of those given) occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def folded() -> pa.RecordBatch:
            f, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)), pa.array(n.astype(np.int64))], names=["feature", "n"])

        for batch in batches:
            for _, _, found in _features(batch, 0):
                if among is not None:
                    found = [(r[m], h[m]) for r, h in found for m in [_in(h, among)[0]]]
                held += _per_document(found)
                if sum(map(len, held)) > 1 << 21:
                    yield folded()
                    held.clear()
        if held:
            yield folded()

    return labelled.select("text").mapInArrow(tidy(run), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _in(h: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``h`` of values that are in the sorted table, and their places there."""
    if not len(table) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.zeros(1 << 20, bool)
    seen[(table & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, h[maybe]), len(table) - 1)
    same = table[at] == h[maybe]
    return maybe[same], at[same]


def _hits(batch: pa.RecordBatch, column: int, features: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row, feature's place, occurrences) of the model's features."""
    for lo, hi, found in _features(batch, column):
        key = []
        for row, h in found:
            at, place = _in(h, features)
            key.append(row[at] * len(features) + place)
        key, n = np.unique(np.concatenate(key), return_counts=True)
        yield lo, hi, key // max(1, len(features)), key % max(1, len(features)), n


def _ratio(t: np.ndarray, n: np.ndarray, toxic: int, total: int) -> np.ndarray:
    """Likelihood ratio of 'occurs' against 'toxic', negative where it marks text that is not toxic."""

    def part(a: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(a > 0, a * np.log(np.maximum(a, 1e-12) / np.maximum(expected, 1e-12)), 0)

    cells = ((t, n * toxic / total), (n - t, n * (total - toxic) / total), (toxic - t, (total - n) * toxic / total), (total - toxic - n + t, (total - n) * (total - toxic) / total))
    return 2 * sum(part(a, e) for a, e in cells) * np.where(t * total > n * toxic, 1, -1)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, n_features: int, ridge: float = 0.02, steps: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the proportional-odds model for sparse rows, by accelerated gradient steps on the mean
    log likelihood with a ridge on the weights.  Thresholds stay ordered: their gaps are exponentials."""
    n, k = len(grade), int(grade.max(initial=0))
    share = np.array([np.clip((grade >= i).mean(), 1e-6, 1 - 1e-6) for i in range(1, k + 1)])
    theta = np.log((1 - share) / share)
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(k))
    par = np.concatenate((np.zeros(n_features), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))))
    m, v = np.zeros_like(par), np.zeros_like(par)
    at = np.arange(n)
    for step in range(1, steps + 1):
        w, th = par[:n_features], np.cumsum(np.concatenate((par[n_features : n_features + 1], np.exp(par[n_features + 1 :]))))
        score = np.bincount(rows, values * w[cols], n)
        s = 1 / (1 + np.exp(np.clip(th[None, :] - score[:, None], -50, 50)))  # P(grade >= 1..k)
        s = np.hstack((np.ones((n, 1)), s, np.zeros((n, 1))))
        d = s * (1 - s)
        p = np.maximum(s[at, grade] - s[at, grade + 1], 1e-12)
        up, down = d[at, grade] / p, d[at, grade + 1] / p
        g_w = -np.bincount(cols, values * (up - down)[rows], n_features) / n + ridge / n * w
        g_th = np.array([(np.where(grade == i, up, 0) - np.where(grade + 1 == i, down, 0)).sum() for i in range(1, k + 1)]) / n
        tail = np.cumsum(g_th[::-1])[::-1]
        g = np.concatenate((g_w, tail[:1], tail[1:] * np.exp(par[n_features + 1 :])))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        par = par - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return par[:n_features], np.cumsum(np.concatenate((par[n_features : n_features + 1], np.exp(par[n_features + 1 :]))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED) -> Model:
    """The model, from a bounded sample of labelled rows."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) > 0).alias("toxic")).where("id is not null and toxic is not null").distinct()
    total = known.count()
    known = cut(known.where(F.expr(f"pmod(xxhash64(id, 17L), 1048576) < {int(min(1.0, labelled / max(1, total)) * 1048576)}")))
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(checked_broadcast(known), "id")
    part = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(GRADES)).cast("int")
    sample = cut(sample.groupBy("id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text", part.alias("part")))
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, total = size.get(True, 0), sum(size.values())
    if not toxic or toxic == total:
        return none
    # Features of toxic documents first; only these are counted over all labelled rows.
    few = _counted(sample.where("toxic"), None).where(f"n >= {max(3, toxic // 500)}").toPandas().sort_values("feature")
    among = np.sort(few["feature"].to_numpy().astype(np.uint64))
    counts = _counted(sample, among).toPandas().merge(few, on="feature", suffixes=("", "_toxic"))
    ratio = _ratio(counts["n_toxic"].to_numpy(float), counts["n"].to_numpy(float), toxic, total)
    counts["ratio"] = ratio
    counts = counts[(ratio >= LEAST_RATIO) & (counts["n_toxic"] * 2 >= counts["n"])]
    features = np.sort(counts.sort_values(["ratio", "feature"], ascending=[False, True]).head(FEATURES)["feature"].to_numpy().astype(np.uint64))
    if not len(features):
        return none

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, row, place, n in _hits(batch, 1, features):
                off = np.searchsorted(row, np.arange(hi - lo + 1))
                toxic_part = [batch.column(c).slice(lo, hi - lo) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([*toxic_part, T.ragged(place, off, pa.int64()), T.ragged(n, off, pa.int64())], names=["toxic", "part", "place", "n"])

    got = sample.mapInArrow(tidy(rows), "toxic boolean, part int, place array<long>, n array<long>").toPandas()
    length = got["place"].map(len).to_numpy()
    row = np.repeat(np.arange(len(got)), length)
    place = np.concatenate([np.asarray(x, np.int64) for x in got["place"]])
    n = np.concatenate([np.asarray(x, np.int64) for x in got["n"]])
    is_toxic = got["toxic"].to_numpy(bool)
    grade = _agreed(row, place, np.log1p(n), is_toxic, got["part"].to_numpy(), len(features))
    return Model(features, *fit_ordinal(row, place, np.log1p(n), grade, len(features)))


def _agreed(row: np.ndarray, place: np.ndarray, value: np.ndarray, is_toxic: np.ndarray, part: np.ndarray, n_features: int) -> np.ndarray:
    """The rows' grades: 0 if not toxic, else 1 and one more for each model fitted on another part that calls the row
    toxic; grades from 0 without a gap."""
    votes = np.zeros(len(is_toxic), np.int64)
    for p in range(GRADES):
        own = part[row] == p
        here = np.flatnonzero(part == p)
        if not is_toxic[here].any() or is_toxic[here].all():
            continue
        index = np.zeros(len(part), np.int64)
        index[here] = np.arange(len(here))
        w, theta = fit_ordinal(index[row[own]], place[own], value[own], is_toxic[here].astype(np.int64), n_features, steps=300)
        score = np.bincount(row, value * w[place], len(part))
        votes += (part != p) & (score >= theta[0])
    return np.unique(np.where(is_toxic, 1 + votes, 0), return_inverse=True)[1]


def score(docs: DataFrame, model: Model, reject_at: float = REJECT_AT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, expected_severity (0 to the highest grade), p_toxic (P(grade >= 1)), severity_grade and is_toxic
    (p_toxic at least ``reject_at``)."""
    names = ["expected_severity", "p_toxic", "severity_grade", "is_toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, row, place, n in _hits(batch, 1, model.features):
                value = np.bincount(row, np.log1p(n) * model.weights[place], hi - lo) if len(row) else np.zeros(hi - lo)
                p = model.at_least(value)
                first = p[:, 0] if p.shape[1] else np.zeros(hi - lo)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(p.sum(axis=1)), pa.array(first), pa.array((p >= 0.5).sum(axis=1).astype(np.int32)), pa.array(first >= reject_at)], names=["id", *names]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(tidy(run), "id long, expected_severity double, p_toxic double, severity_grade int, is_toxic boolean")
    return out.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, model: Model, reject_at: float = REJECT_AT, text_col: str = "text") -> DataFrame:
    """The rows that are not rejected, with all their columns, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index(text_col)
            for lo, hi, row, place, n in _hits(batch, column, model.features):
                value = np.bincount(row, np.log1p(n) * model.weights[place], hi - lo) if len(row) else np.zeros(hi - lo)
                p = model.at_least(value)
                kept = p[:, 0] < reject_at if p.shape[1] else np.ones(hi - lo, bool)
                yield batch.slice(lo, hi - lo).filter(pa.array(kept))

    return docs.mapInArrow(tidy(run), docs.schema)
