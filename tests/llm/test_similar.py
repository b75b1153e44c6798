"""The Jaccard join, fingerprints and licenses against brute force."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pytest
from helpers import shingles, words
from pyspark.sql import functions as F

from blockloom.llm import cluster, fingerprint, jaccard, licenses


def brute(rows, k, percent):
    """id -> smallest id reachable by links."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in index.get(g, ())).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            index.setdefault(g, []).append(i)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_documents(documents, k, percent):
    want, size = brute([(r["doc_id"], r["text"]) for r in documents.collect()], k, percent)
    got = jaccard.similar_sets(documents, k=k, percent=percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == size


def test_a_chain_of_edits_and_a_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 99999)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = base.copy()
        for p in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            w[p] = f"x{rng.randint(0, 99999)}"
        rows.append((1000 - i, " ".join(w)))
    chain = base[::-1]
    for i in range(20):
        chain = chain.copy()
        chain[5 * i] = f"y{i}"
        rows.append((2000 + i, " ".join(chain)))
    rows += [(3000 + i, "a few words that all share " + str(i % 3)) for i in range(30)]
    want, _ = brute(rows, 3, 90)
    got = jaccard.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=90)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_blocks_of_long_lists_and_large_groups_lose_nothing(spark, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 3)
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 500)
    monkeypatch.setattr(jaccard, "FREQUENT", 1)
    want, _ = brute([(r["doc_id"], r["text"]) for r in documents.collect()], 3, 90)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.similar_sets(documents, k=3, percent=90).collect()} == want


def test_answers_derived_from_a_similar_set_equal_counted_ones():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 40, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate((np.delete(base, rng.integers(0, len(base), 12)), rng.integers(0, 1 << 40, int(rng.integers(1, 12))).astype(np.uint64)))) for _ in range(60)]
    forest = jaccard.links_within(np.arange(60), sets, 90)
    root = list(range(60))

    def find(x, r):
        while r[x] != x:
            x = r[x]
        return x

    for a, b in forest:
        root[find(a, root)] = find(b, root)
    full = list(range(60))
    for a in range(60):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 90 * (len(sets[a]) + len(sets[b]) - n):
                full[find(a, full)] = find(b, full)
    assert len({find(x, root) for x in range(60)}) == len({find(x, full) for x in range(60)})
    assert all((find(a, root) == find(b, root)) == (find(a, full) == find(b, full)) for a in range(60) for b in range(a))


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_a_thousand_repeats_of_a_row(spark, documents, monkeypatch, broadcast):
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(cluster, "HOT", 20)
    rng = random.Random(8)
    text = [f"w{rng.randint(0, 9999)}" for _ in range(300)]
    near = [*text[:-1], "other"]
    few = documents.select("doc_id", "text").limit(150)
    df = few.unionByName(spark.createDataFrame([(-5, " ".join(text))] * 1000 + [(-7, " ".join(near))] * 3, "doc_id long, text string"))
    want, size = brute([(r["doc_id"], r["text"]) for r in df.distinct().collect()], 3, 90)
    began = time.monotonic()
    got = jaccard.similar_sets(df, k=3, percent=90).collect()
    assert time.monotonic() - began < 60
    assert Counter((r["doc_id"], r["component_id"], r["n_shingles"]) for r in got) == Counter((r["doc_id"], want[r["doc_id"]], size[r["doc_id"]]) for r in df.collect())


def test_an_id_with_several_texts(spark):
    """One of the texts counts, the same in every run, and all rows of the id share its component."""
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    df = spark.createDataFrame([(1, a), (2, a), (3, b), (9, a), (9, b), (9, None), (None, b), (None, "x y z")], "doc_id long, text string")
    runs = [Counter(map(tuple, jaccard.similar_sets(df.repartition(n), k=3, percent=90).select("doc_id", "n_shingles", "component_id").collect())) for n in (1, 3, 4)]
    assert runs[0] == runs[1] == runs[2]
    of = {(i, n): c for i, n, c in runs[0]}
    assert of[9, 0] == of[9, 48] and of[9, 48] in (1, 3) and of[1, 48] == of[2, 48] == 1 and of[3, 48] == of[None, 48] == 3 and of[None, 1] is None


def test_odd_rows(odd, nothing):
    got = jaccard.similar_sets(odd, k=3, percent=90).collect()
    assert len(got) == odd.count()
    assert {(r["doc_id"], r["n_shingles"]) for r in got} >= {(1, 0), (2, 0), (3, 0), (5, 1), (4, 29998)}
    assert all(r["component_id"] == r["doc_id"] for r in got if r["doc_id"] is not None)
    assert jaccard.similar_sets(nothing).count() == 0


def test_clashing_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, "a b c d", "x", 1), (2, "a b c d", "y", 2)], "doc_id long, text string, component_id string, size long")
    assert {r["component_id"] for r in jaccard.similar_sets(df).collect()} == {1}


def test_fingerprints(documents):
    rows = sorted(((r["doc_id"], r["text"]) for r in documents.collect()), reverse=True)
    found = fingerprint.fingerprints(documents)
    found = found.select("doc_id", "edited", "n_chars", fingerprint.spelt(F.col("sketch")).alias("f"), fingerprint.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near"), fingerprint.likeness(F.col("sketch"), F.col("next_sketch")).alias("next"))
    got = {r["doc_id"]: r for r in found.collect()}
    by_length: dict[int, list[float]] = {}
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i]["edited"] == edited and got[i]["n_chars"] == len(t)
        a, b, c = shingles(t, 5), shingles(edited, 5), shingles(after, 5)
        for near, x in ((got[i]["near"], b), (got[i]["next"], c)):
            true, n_hashes = len(a & x) / len(a | x), len(a | x) / fingerprint.ONE_IN
            assert abs(near - true) <= 5 * (true * (1 - true) / n_hashes) ** 0.5 + 0.02 or n_hashes < 8
            by_length.setdefault(int(np.log2(len(a | x))), []).append(abs(near - true))
    # The error by the number of shingles (a power of two): the rarer, the larger.
    assert all(np.mean(e) < 0.9 / (2**n / fingerprint.ONE_IN) ** 0.5 for n, e in by_length.items() if len(e) >= 8), {n: np.mean(e) for n, e in by_length.items()}
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t, set()).add(got[i]["f"])
    assert all(len(x) == 1 for x in by_text.values())


def test_sketches_hold_every_hash_below_the_threshold(spark, documents):
    """Against the hashes of all shingles, made one by one."""
    short = spark.createDataFrame([(-1, "One two"), (-2, "a b c d e"), (-3, " ")], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(short)
    by_doc = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    runs = [(i, *w[j : j + 5]) for i, w in by_doc.items() for j in range(len(w) - 4)]
    whole = [(i, " ".join(w)) for i, w in by_doc.items() if 0 < len(w) < 5]
    hashed = spark.createDataFrame(runs, "i long, a string, b string, c string, d string, e string").select("i", F.xxhash64("a", "b", "c", "d", "e").alias("h"))
    hashed = hashed.unionByName(spark.createDataFrame(whole, "i long, w string").select("i", F.xxhash64(F.lit(5), F.col("w")).alias("h")))
    want: dict[int, set[int]] = {}
    for r in hashed.collect():
        if r["h"] < -(1 << 63) + (1 << 62):
            want.setdefault(r["i"], set()).add(r["h"])
    got = docs.select("doc_id", fingerprint.sketch(F.col("text")).alias("s")).collect()
    assert fingerprint.ONE_IN == 4 and all(r["s"]["hashes"] == sorted(want.get(r["doc_id"], ())) for r in got)
    assert [r["s"]["words"] for r in got if r["doc_id"] == -3] == [None]


def ring(rows):
    """Each row's text and its neighbour's, by descending id, null last, equal ids by falling hash of the text."""
    ordered = sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), -r["h"]))
    return Counter((r["doc_id"], r["text"], ordered[(n + 1) % len(ordered)]["text"]) for n, r in enumerate(ordered))


@pytest.mark.parametrize("range_bytes,cells", [(32 << 20, 256), (100, 4)])
def test_neighbours_of_repeated_and_null_ids(spark, monkeypatch, range_bytes, cells):
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(fingerprint, "CELLS", cells)
    monkeypatch.setattr(fingerprint, "PIECE", 7)
    rng = random.Random(4)
    rows = [(None, f"null {i % 30}") for i in range(90)] + [(50, f"hot {i % 40}") for i in range(120)] + [(50, "same text")] * 30 + [(rng.randint(-5, 200) * 1000, f"one {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    distinct, hot, repeats = fingerprint._counted(df)
    found = fingerprint.fingerprints(df)
    assert repeats and (50 in hot)
    # A neighbour shows in the edited text: what follows the own half.
    want = Counter()
    for (i, t, after), n in ring(df.withColumn("h", F.xxhash64("text")).collect()).items():
        want[i, t[: len(t) - len(t) // 2] + after[: len(t) // 2]] += n
    assert Counter((r["doc_id"], r["edited"]) for r in found.collect()) == want


def test_fingerprints_of_odd_rows(odd, nothing):
    got = fingerprint.fingerprints(odd).collect()
    assert len(got) == odd.count() and all(r["n_chars"] is not None for r in got)
    assert fingerprint.fingerprints(nothing).count() == 0
    one = fingerprint.fingerprints(odd.where("doc_id = 5")).first()
    assert one["edited"] == "one one"


def test_sketches_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(900)), " ".join(f"b{i}" for i in range(900))
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, ab string")
    s = {c: fingerprint.sketch(F.col(c)) for c in ("a", "b", "ab")}
    r = df.select(fingerprint.containment(s["a"], s["ab"]).alias("in_"), fingerprint.containment(fingerprint.merged(s["a"], s["b"]), s["ab"]).alias("both")).first()
    assert r["in_"] == 1 and r["both"] == 1


def alnum_words(text):
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()


def test_licenses_against_search(documents):
    """Every notice that is in a text word for word is found, and what is found is in the text but for a fifth."""
    key = lambda t: f" {' '.join(alnum_words(t))} "
    told = licenses.templates()
    want = {(r["doc_id"], *n) for r in documents.collect() for n, t in told.items() if key(t) in key(r["text"])}
    found = licenses.scan(documents).collect()
    got = {(r["doc_id"], r["license"], r["kind"]) for r in found}
    assert want and got >= want
    for r in documents.where(F.col("doc_id").isin([r["doc_id"] for r in found])).collect():
        have = shingles(" ".join(alnum_words(r["text"])), 5)
        for m in found:
            if m["doc_id"] == r["doc_id"]:
                own = shingles(" ".join(alnum_words(told[m["license"], m["kind"]])), 5)
                assert len(own & have) >= (0.8 if len(own) <= licenses.PASSAGE else 0.8 * 46 / len(own)) * len(own)


def test_licenses_partial_places_and_odd_rows(spark, odd, nothing):
    told = licenses.templates()
    gpl = told["GPL-3.0", "header"]
    cut = " ".join(gpl.split()[:-6])
    less = " ".join(gpl.split()[:15])
    pad = " ".join(f"p{i}" for i in range(37))
    df = spark.createDataFrame([(1, f"{pad} {gpl} {pad} {gpl}"), (2, f"{pad}\n{cut.upper()}"), (3, less), (4, f"{pad} {told['Apache-2.0', 'text']}")], "doc_id long, text string").withColumn("license", F.lit(1))
    got = sorted((r["doc_id"], r["license"], r["first_word"]) for r in licenses.scan(df).where("kind = 'header' and license = 'GPL-3.0'").collect())
    n = len(alnum_words(gpl))
    assert got == [(1, "GPL-3.0", 37), (1, "GPL-3.0", 37 + n + 37), (2, "GPL-3.0", 37)]
    whole = licenses.scan(df).where("doc_id = 4 and kind = 'text' and license = 'Apache-2.0'").collect()
    assert [(r["first_word"], r["containment"]) for r in whole] == [(37, 1.0)]
    assert licenses.scan(odd).count() == 0 and licenses.scan(nothing).count() == 0


def test_recall_of_edited_and_partial_copies(spark):
    """Passages of which four fifths and more are left after edits, against brute-force containment."""
    rng = random.Random(12)
    told = {k: t for k, t in licenses.templates().items() if k in {("MIT", "text"), ("GPL-2.0", "text"), ("Apache-2.0", "text"), ("MPL-2.0", "text"), ("LGPL-2.1", "text")}}
    rows, want = [], []
    for i in range(240):
        name = rng.choice(sorted(told))
        w = alnum_words(told[name])
        a = 100 * rng.randrange(max(1, len(w) // 100 - 1))
        passage = w[a : a + 100]
        edited = passage.copy()
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(edited))
            edited[at : at + 1] = rng.choice([[], [f"new{rng.randint(0, 99)}"], [edited[at], f"more{rng.randint(0, 99)}"]])
        pad = [f"x{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 400))]
        rows.append((i, " ".join(pad + edited + pad[::-1])))
        have, own = shingles(" ".join(edited), 5), shingles(" ".join(passage), 5)
        if len(passage) == 100 and len(have & own) >= 0.8 * len(own):
            want.append((i, name[0]))
    found = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), told).collect()}
    recall = np.mean([x in found for x in want])
    assert len(want) > 80 and recall >= 0.98, recall
