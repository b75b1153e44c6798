"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Templates are the full texts of common licenses (``templates/<SPDX identifier>.txt``), their usual headers and one-line
notices (``NOTICES``).  A text longer than ``PASSAGE`` words is cut into passages of about that length, so that partial
copies are found by the passages they hold; passages are retrieved and verified one by one and put together again.

Passages are grouped by length; for a group whose longest has w words, windows of 2v shingles start every v shingles, v
being ``SLACK`` times w, so any run of v words lies whole in one of them.  A window and a passage become candidates if
they agree in a band, one minimum of a multiplicative hash.  The number of bands follows from ``CERTAIN``: a window that
holds ``contained`` of the group's shortest passage has at least a known Jaccard similarity s with it, and
1 - (1 - s)^bands must reach ``CERTAIN``; tests measure the recall that is reached.  Every candidate is then verified
exactly: the share of the passage's shingles (five words) that the window holds must reach ``contained``.

Words are runs of letters and digits, lower-cased A-Z, so punctuation and line breaks don't matter.  A document has one
row for each template and place: matches of one template that overlap, or are at most ``GAP`` words apart, are one, and
``containment`` is the share of the whole template's shingles that its passages there hold.  A passage that several
licenses share is told for each.  Null and empty texts match nothing; repeated rows are matched as often as they occur;
null ids stay null; other columns are ignored.  Templates need five words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import text as T
from blockloom.llm.cluster import tidy

SHINGLE = 5
CONTAINED = 0.8
CERTAIN = 0.999
#: Words of a passage; a last piece of less than half of it belongs to the one before.
PASSAGE = 100
SLACK = 1.25
GAP = 10

# One-line notices and headers, by SPDX identifier and kind.
NOTICES = {
    ("Apache-2.0", "notice"): "Licensed under the Apache License, Version 2.0.",
    ("MIT", "notice"): "Released under the MIT License.",
    ("GPL-3.0", "notice"): "This work is licensed under the GNU General Public License, version 3.",
    ("CC-BY-NC-4.0", "notice"): "Licensed under CC BY-NC 4.0.",
    ("CC-BY-4.0", "notice"): "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ("CC-BY-SA-4.0", "notice"): "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ("CC-BY-NC-4.0", "sentence"): "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ("MPL-2.0", "header"): (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    ("Apache-2.0", "header"): (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    ),
    ("GPL-2.0", "header"): (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    ("GPL-3.0", "header"): (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    ("AGPL-3.0", "header"): (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    ("LGPL-2.1", "header"): (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
}


def templates() -> dict[tuple[str, str], str]:
    """All templates by (SPDX identifier, kind)."""
    files = sorted((Path(__file__).parent / "templates").glob("*.txt"))
    return NOTICES | {(f.stem, "text"): f.read_text(encoding="utf-8") for f in files}


@dataclass
class Group:
    """Passages of like length: window step, their templates, shingles, and for each band the sorted minima with the
    passages they belong to."""

    width: int
    owner: list[int]
    shingles: list[np.ndarray]
    factors: np.ndarray
    minima: np.ndarray
    passage: np.ndarray


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    word = T.words(data, np.array([0, len(data)]), T.NOT_ALNUM)[0]
    if len(word) < SHINGLE:
        raise ValueError(f"a template needs {SHINGLE} words: {text[:40]!r}")
    return word


def _passages(word: np.ndarray) -> list[np.ndarray]:
    """The distinct shingles of each passage of a template."""
    cuts = list(range(0, len(word), PASSAGE)) or [0]
    if len(cuts) > 1 and len(word) - cuts[-1] < PASSAGE // 2:
        cuts.pop()
    return [np.unique(T.shingles(w, np.array([0, len(w)]), SHINGLE)[0]) for w in (word[a:z] for a, z in zip(cuts, [*cuts[1:], len(word)], strict=True))]


def groups(told: dict[tuple[str, str], str], contained: float = CONTAINED, certain: float = CERTAIN) -> tuple[list[tuple[str, str, int]], list[Group]]:
    """(license, kind, shingles) of the templates, and their passages in groups whose lengths are within a half of each
    other, with bands for the guarantee."""
    names, pieces = [], []
    for (name, kind), text in sorted(told.items()):
        own = _passages(_words(text))
        pieces += [(len(p), len(names), p) for p in own]
        names.append((name, kind, sum(map(len, own))))
    pieces.sort(key=lambda x: x[:2])
    out: list[Group] = []
    while pieces:
        shortest = pieces[0][0]
        own = [x for x in pieces if x[0] <= max(shortest * 3 // 2, shortest + 2)]
        pieces = pieces[len(own) :]
        width = math.ceil(SLACK * own[-1][0])
        # A window with the least match: its shingles are at most 2 * width, some may be the passage's others.
        hit = math.ceil(contained * shortest)
        similar = hit / (2 * width + shortest - hit)
        bands = math.ceil(math.log(1 - certain) / math.log(1 - similar)) if similar < 1 else 1
        rng = np.random.Generator(np.random.PCG64(97 + width))
        factors = rng.integers(0, 1 << 62, bands).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        minima = np.array([[(s * f).min() for _, _, s in own] for f in factors], np.uint64)
        order = np.argsort(minima, axis=1, kind="stable")
        out.append(Group(width, [t for _, t, _ in own], [s for _, _, s in own], factors, np.take_along_axis(minima, order, 1), order))
    return names, out


def _candidates(group: Group, h: np.ndarray, start: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, passage) that agree in a band; ``start`` of the half windows, ``last``: no half follows in the text."""
    found = []
    product = np.empty_like(h)
    for b, f in enumerate(group.factors):
        np.multiply(h, f, out=product)
        low = np.minimum.reduceat(product, start)
        pair = low.copy()
        pair[:-1] = np.where(last[:-1], low[:-1], np.minimum(low[:-1], low[1:]))
        a, z = np.searchsorted(group.minima[b], pair, side="left"), np.searchsorted(group.minima[b], pair, side="right")
        for w in np.flatnonzero(z > a).tolist():
            found += [w * len(group.owner) + p for p in group.passage[b, a[w] : z[w]].tolist()]
    pairs = np.unique(np.array(found, np.int64))
    return pairs // len(group.owner), pairs % len(group.owner)


def _matches(built: list[Group], names: list[tuple[str, str, int]], h: np.ndarray, off: np.ndarray, contained: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, template, first word, end word, containment) in one chunk of texts."""
    n = np.diff(off)
    # (row, template) -> the passages found: first word, end word, passage, its shingles found.
    held: dict[tuple[int, int], list[tuple[int, int, tuple[int, int], int]]] = {}
    for g, group in enumerate(built):
        count = -(-n // group.width)
        if not count.sum():
            continue
        doc = np.repeat(np.arange(len(n)), count)
        first = np.concatenate(([0], np.cumsum(count)))[:-1]
        start = off[:-1][doc] + group.width * (np.arange(len(doc)) - first[doc])
        last = np.ones(len(doc), bool)
        last[:-1] = doc[1:] != doc[:-1]
        for w, p in zip(*(x.tolist() for x in _candidates(group, h, start, last)), strict=True):
            d = int(doc[w])
            a, z = int(start[w]), min(int(start[w]) + 2 * group.width, int(off[d + 1]))
            where = np.flatnonzero(np.isin(h[a:z], group.shingles[p]))
            begin, least = a - int(off[d]), contained * len(group.shingles[p])
            # Copies beside each other are matches of their own; scattered pieces are one if together they are enough.
            alone = [x for x in np.split(where, np.flatnonzero(np.diff(where) > 2 * GAP) + 1) if len(np.unique(h[a:z][x])) >= least]
            for x in alone or [where]:
                hit = len(np.unique(h[a:z][x]))
                if hit >= least:
                    held.setdefault((d, group.owner[p]), []).append((begin + int(x[0]), begin + int(x[-1]) + SHINGLE, (g, p), hit))
    for (d, t), spans in sorted(held.items()):
        spans.sort()
        begin, end, best = spans[0][0], spans[0][1], {spans[0][2]: spans[0][3]}
        for a, z, p, hit in [*spans[1:], (1 << 60, 0, (-1, -1), 0)]:
            if a <= end + GAP:
                end = max(end, z)
                best[p] = max(hit, best.get(p, 0))
            else:
                yield d, t, begin, end, min(1.0, sum(best.values()) / names[t][2])
                begin, end, best = a, z, {p: hit}


def scan(docs: DataFrame, told: dict[tuple[str, str], str] | None = None, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license, kind, first_word, end_word (words counted from 0) and containment of every match."""
    names, built = groups(templates() if told is None else told, contained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, buf, off in T.chunks(batch.column(1)):
                word, _, _, word_off = T.words(buf, off, T.NOT_ALNUM)
                h, at = T.shingles(word, word_off, SHINGLE)
                found = list(_matches(built, names, h, at, contained))
                if found:
                    d, t, a, z, share = map(list, zip(*found, strict=True))
                    ids = batch.column(0).take(pa.array([lo + x for x in d]))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([names[x][0] for x in t]), pa.array([names[x][1] for x in t]), pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array(share)],
                        names=["id", "license", "kind", "first_word", "end_word", "containment"],
                    )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "id long, license string, kind string, first_word long, end_word long, containment double").withColumnRenamed("id", id_col)
