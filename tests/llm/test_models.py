"""Toxicity, language identification, mixing, sharding, top-k and the pipeline."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import words
from pyspark.sql import functions as F

from blockloom.llm import langid, mixing, sharding, topk, toxicity
from blockloom.llm import text as T


def test_ordinal_regression_recovers_order():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (600, 3))
    score = x @ np.array([1.5, 0.0, -1.0]) + rng.logistic(size=600)
    grade = (score > 0).astype(int) + (score > 2.5)
    rows, cols = np.nonzero(x)
    w, th = toxicity.fit_ordinal(rows, cols, x[rows, cols].astype(float), grade, 3)
    assert abs(w[0] - 1.5) < 0.4 and abs(w[1]) < 0.3 and abs(w[2] + 1) < 0.4 and abs(th[0]) < 0.4 and abs(th[1] - 2.5) < 0.5


def planted(spark, n=600):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        w = [f"{rng.choice(['al', 'be', 'ga', 'de'])}{rng.choice(['ro', 'mi', 'tu', 'ka', 'le'])}{rng.randint(0, 20)}" for _ in range(rng.randint(20, 80))]
        bad = i % 8 == 0
        if bad:
            for _ in range(rng.randint(1, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(["vileword", "nasty", f"grimstem{rng.randint(0, 99)}"]))
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_documents_are_found_by_words_and_stems(spark):
    docs, labels = planted(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    held = [r for r in got if r["doc_id"] % 3 == 0]
    assert np.mean([r["is_toxic"] == (r["doc_id"] % 8 == 0) for r in held]) > 0.97
    assert all(abs(r["expected_severity"]) <= 3 and 0 <= r["severity_grade"] <= 3 for r in got)
    kept = {r["doc_id"] for r in toxicity.clean(docs, model).collect()}
    assert kept == {r["doc_id"] for r in got if not r["is_toxic"]}
    assert (np.diff(model.thresholds) > 0).all()


def test_severity_by_brute_force(spark):
    """Probabilities and severities from the model's numbers, in plain Python, word by word."""
    docs, labels = planted(spark)
    model = toxicity.fit(docs, labels)
    hashed = {}

    def feature(word: str, length: int | None) -> int:
        data = np.frombuffer(word.encode(), np.uint8)
        word_hash, st, en, _ = T.words(data, np.array([0, len(data)]), T.NOT_ALNUM)
        return int(word_hash[0] if length is None else T.prefixes(data, st, en, length)[1][0])

    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for r in docs.limit(80).collect():
        n = Counter()
        for w in "".join(c if c.isalnum() else " " for c in r["text"].lower()).split():
            for length in (None, *(x for x in toxicity.PREFIXES if len(w.encode()) > x)):
                n[hashed.setdefault((w, length), feature(w, length))] += 1
        score = sum(math.log1p(k) * weight[f] for f, k in n.items() if f in weight)
        p = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert got[r["doc_id"]]["expected_severity"] == pytest.approx(sum(p)) and got[r["doc_id"]]["p_toxic"] == pytest.approx(p[0])
        assert got[r["doc_id"]]["severity_grade"] == sum(x >= 0.5 for x in p)


def test_grades_come_from_models_that_have_not_seen_the_row():
    rng = np.random.default_rng(2)
    is_toxic = np.arange(300) % 3 == 0
    part = rng.integers(0, toxicity.GRADES, 300)
    plain = is_toxic & (np.arange(300) % 2 == 0)  # marked by the feature that all parts know
    row, place = np.flatnonzero(plain), np.zeros(int(plain.sum()), np.int64)
    grade = toxicity._agreed(row, place, np.ones(len(row)), is_toxic, part, 1)
    assert (grade[~is_toxic] == 0).all() and (grade[plain] == grade.max()).all() and (grade[is_toxic & ~plain] == 1).all()
    assert set(grade.tolist()) == set(range(int(grade.max()) + 1))


def test_toxicity_of_odd_rows(spark, odd, nothing):
    docs, labels = planted(spark)
    model = toxicity.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")))
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and not any(r["is_toxic"] for r in got)
    assert toxicity.score(nothing, model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert not len(none.features) and toxicity.score(docs, none).where("expected_severity <> 0").count() == 0
    assert toxicity.clean(odd, none).count() == odd.count()


def brute_language(text, profiles, ranks=langid.RANKS):
    grams = Counter()
    letters = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for w in "".join(c if c.isalpha() else " " for c in letters).split():
        p = "\0" + w + "\0"
        grams.update(w)
        grams.update(p[i : i + 2] for i in range(len(p) - 1))
        grams.update(p[i : i + 3] for i in range(len(p) - 2))
    return grams


def key(gram: str) -> int:
    k = 0
    for c in gram:
        k = k << 21 | (langid._EDGE if c == "\0" else ord(c))
    return k


def test_profiles_by_brute_force(documents):
    rows = documents.limit(60).collect()
    profiles = langid.learn(documents, F.lit(True))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(documents, profiles).collect()}
    for r in rows:
        grams = brute_language(r["text"], profiles)
        top = [key(g) for g, _ in sorted(grams.items(), key=lambda x: (-x[1], key(x[0])))][: langid.RANKS]
        d = []
        for n in range(len(profiles.names)):
            rank = {int(g): int(k) for g, k in zip(profiles.grams, profiles.rank[n], strict=True) if k >= 0}
            d.append(sum(min(abs(rank[g] - i), langid.RANKS) if g in rank else langid.RANKS for i, g in enumerate(top)))
        best = int(np.argmin(d))
        assert got[r["doc_id"]][0] == profiles.names[best]
        assert got[r["doc_id"]][1] == pytest.approx(1 - d[best] / (len(top) * langid.RANKS))


def test_held_out_languages(documents):
    profiles = langid.learn(documents, ~langid.held_out("doc_id"))
    got = langid.identify(documents, profiles).join(documents.select("doc_id", "lang"), "doc_id").where(langid.held_out("doc_id")).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_languages_of_odd_rows(documents, odd, nothing):
    profiles = langid.learn(documents, F.lit(True))
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(odd, profiles).collect()]
    assert {i for i, x in got if x == "und"} == {1, 2, 3, 6} and len(got) == odd.count()
    assert langid.identify(nothing, profiles).count() == 0
    none = langid.learn(nothing, F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}


def brute_targets(sizes, weights, most):
    """Clamp, redistribute, repeat."""
    total, left, target = sum(sizes.values()), dict(zip(sizes, weights, strict=True)), {}
    while left:
        level = (total - sum(target.values())) / sum(left.values())
        over = [s for s, w in left.items() if w * level > most * sizes[s] + 1e-9]
        if not over:
            return target | {s: w * level for s, w in left.items()}
        for s in over:
            target[s] = most * sizes[s]
            del left[s]
    return target


@pytest.mark.parametrize("seed", range(4))
def test_water_filling(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02}": rng.choice([0, 1, 10, 100, 5000, 100_000]) + rng.randint(1, 9) for i in range(12)}
    weights = [(1.0, 2.0, 3.0)[i % 3] for i in range(12)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([*sizes.items()], "source string, words long"), (1, 2, 3)).collect()}
    want = brute_targets(dict(sorted(sizes.items())), weights, 3)
    assert all(got[s] == pytest.approx(want[s]) for s in sizes)


def test_mix(spark, documents, odd, nothing):
    got = mixing.mix(mixing.sized(documents)).collect()
    size = {r["doc_id"]: len(words(r["text"])) for r in documents.collect()}
    assert all(r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert sum(r["size"] for r in own) == own[0]["source_size"] and abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(mixing.sized(documents)).collect()))
    assert mixing.mix(mixing.sized(odd)).count() == odd.count() and mixing.mix(mixing.sized(nothing)).count() == 0
    again = mixing.repeated(documents)
    assert again.columns == documents.columns
    assert sum(len(words(r["text"])) for r in again.collect()) == pytest.approx(sum(size.values()), rel=0.25)


def test_mix_of_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 50)
    rows = [(7, "a b c d", "x")] * 300 + [(None, f"n{i} b c", "x") for i in range(400)] + [(i, "one two " * (i % 9 + 1), "yz"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("times", F.lit("kept")).withColumn("copy", F.lit(3))
    got = mixing.mix(mixing.sized(df)).collect()
    assert len(got) == df.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    groups = {"x": 700 // 50, "y": 2, "z": 2}
    for s in "xyz":
        own = [r for r in got if r["source"] == s]
        assert own[0]["source_size"] == sum(r["size"] for r in own) and abs(sum(r["taken"] for r in own) - own[0]["target"]) <= groups[s]
    again = mixing.repeated(df)
    assert again.columns == df.columns and {(r["times"], r["copy"]) for r in again.collect()} == {("kept", 3)}
    for s in "xyz":
        target = next(r["target"] for r in got if r["source"] == s)
        assert sum(len(words(r["text"])) for r in again.where(F.col("source") == s).collect()) == pytest.approx(target, rel=0.25)


def test_shards(documents, odd, nothing):
    got = sharding.shard(documents).collect()
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in got)
    together = {}
    for r in got:
        together.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert all(len(x) == 1 for x in together.values())
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    for s in loads:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.shard(odd).count() == odd.count() and sharding.shard(nothing).count() == 0


def plain_schedule(groups, shards):
    """Digest -> shard: every group on its own, largest first, to the least loaded."""
    heap, placed = [(0, s) for s in range(shards)], {}
    for digest, size in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        placed[digest] = s
        heapq.heappush(heap, (load + size, s))
    return placed


@pytest.mark.parametrize("seed", range(5))
def test_turns_of_a_run(seed):
    rng = random.Random(seed)
    shards, size = rng.randint(1, 9), rng.randint(1, 12)
    loads = [rng.choice([0, 5, 12, 40, 41, 300]) for _ in range(shards)]
    heap, want = [(x, s) for s, x in enumerate(loads)], []
    heapq.heapify(heap)
    for _ in range(400):
        load, s = heapq.heappop(heap)
        want.append(s)
        heapq.heappush(heap, (load + size, s))
    ranks = np.array(rng.sample(range(400), 300))
    assert sharding.turns(np.array(loads), size, ranks).tolist() == [want[r] for r in ranks]


def test_schedule_is_the_plain_one_above_40000_groups(spark, documents, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 700)
    many = spark.range(45_000).select(F.col("id").alias("doc_id"), F.concat(F.lpad(F.col("id").cast("string"), 6, "x"), F.repeat(F.lit("y"), (F.pow(F.col("id") % 17, F.lit(2))).cast("int"))).alias("text"))
    again = many.where("doc_id < 30").withColumn("doc_id", F.lit(7).cast("long"))
    df = many.unionByName(again).unionByName(documents.select("doc_id", "text"))
    rows = df.collect()
    groups = Counter()
    for r in rows:
        groups[hashlib.sha256(r["text"].encode()).hexdigest()] += len(r["text"].encode()) + 16
    want = plain_schedule(groups, 40)
    got = sharding.shard(df).collect()
    assert Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in got) == Counter((r["doc_id"], zlib.crc32(r["text"].encode()), want[hashlib.sha256(r["text"].encode()).hexdigest()]) for r in rows)
    for s in range(40):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_a_row_repeated_ten_thousand_times(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT", 100)
    df = spark.range(12_000).select(F.when(F.col("id") < 10_000, 5).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 10_000, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.shard(df, 4).collect()
    assert len(got) == 12_000 and len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


@pytest.mark.parametrize("shard,leaf", [(4096, 128), (60, 4)])
def test_top_k_by_brute_force(spark, small, monkeypatch, shard, leaf):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "LEAF", leaf)
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    same = rows.limit(1).crossJoin(spark.range(30)).select((F.col("id") + 10_000).alias("vec_id"), "embedding", "label")
    rows = rows.unionByName(same).unionByName(spark.createDataFrame([(20_000, None, 1), (20_100, [float("nan")] * 64, 1), (20_200, [None] * 64, 1), (None, [0.0] * 64, 1), (20_300, [1.0], 1)], rows.schema))
    e = [(r["vec_id"], np.floor(np.array(r["embedding"], np.float64) * 1024).astype(np.int64)) for r in rows.where("vec_id < 20000").collect()]
    got = sorted(map(tuple, topk.search(rows, F.col("vec_id") % 100 == 0).collect()))
    want = []
    for i, q in e:
        if i % 100 == 0:
            best = sorted(((-int(q @ v), j) for j, v in e if j != i))[:10]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_queries_are_sent_only_to_cells_that_may_hold_as_good_a_score():
    rng = np.random.default_rng(6)
    places = rng.normal(0, 3000, (8, 16))
    v = np.floor(np.concatenate([p + rng.normal(0, 40, (200, 16)) for p in places]))
    cells = topk.Cells(v[::3], 8)
    cell, away = cells.of(v)
    radius = np.array([away[cell == c].max(initial=-1) for c in range(8)])
    q = v[:50]
    kth = np.sort(q @ v.T, axis=1)[:, -10]
    batch = pa.record_batch({"id": pa.array(range(50)), "kth": pa.array(kth), "vector": pa.array(list(q))})
    (out,) = topk._open_cells(cells, radius, 1.0)(iter([batch]))
    sent = set(zip(out.column("id").to_pylist(), out.column("cell").to_pylist(), strict=True))
    assert len(sent) < 50 * 8 * 3 / 4  # the others are skipped
    assert all((i, int(cell[j])) in sent for i in range(50) for j in np.flatnonzero(q[i] @ v.T >= kth[i]))


def test_top_k_of_few_and_none(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    assert topk.search(rows.where("vec_id < 4"), F.col("vec_id") % 100 == 0).count() == 3
    assert topk.search(rows.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.search(rows.where("vec_id = 7"), F.col("vec_id") % 100 == 0).count() == 0


def test_large_components_are_exact():
    a = np.array([[2.0**40, 3.0], [1.0, 2.0**30]])
    assert topk.exact_dot(a, np.array([[2.0**20, 1.0]])).tolist() == [[2**60 + 3], [2**20 + 2**30]]
    with pytest.raises(OverflowError):
        topk.exact_dot(np.array([[2.0**40]]), np.array([[2.0**30]]))


def test_pipeline_stages(spark, small, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, seen[-1], small).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(d.columns == columns for d in seen[:-1])
    ids = [Counter(r["doc_id"] for r in d.select("doc_id").collect()) for d in seen]
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    assert set(ids[1]) == {r["doc_id"] for r in toxicity.score(docs, model).where("not is_toxic").collect()}
    assert set(ids[2]) <= set(ids[1]) and len(ids[2]) > 0.95 * len(ids[1])
    from helpers import shingles

    texts = [(r["doc_id"], shingles(r["text"], 5)) for r in seen[3].collect()]
    assert not any(x and 10 * len(x & y) >= 8 * len(x | y) for n, (_, x) in enumerate(texts) for _, y in texts[:n])
    taken = {r["doc_id"]: round(r["taken"] / r["size"]) for r in mixing.mix(mixing.sized(seen[3])).where("size > 0").collect()}
    assert ids[4] == Counter({i: n for i, n in taken.items() if n})
    assert ids[5] == ids[4]


def test_pipeline_stages_on_odd_rows(spark, odd, nothing, small):
    import corpus_pipeline as C

    for df in (odd, nothing):
        for name, stage in C.STAGES:
            got = stage(spark, df, small)
            assert got.count() <= 3 * df.count(), name
            assert name == "bpe" or got.columns == df.columns
    assert C.one_of_each_group(spark, odd, small).where("doc_id = 4").count() == 1


def test_pipeline_stages_with_clashing_columns(spark, small):
    import corpus_pipeline as C

    names = ["gone", "_gone", "first", "times", "_times", "copy", "words", "size", "component_id", "id", "_copy", "row", "own", "rep", "lang_pred"]
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(5)).select("*", *[F.lit(f"kept {n}").alias(n) for n in names])
    for name, stage in C.STAGES:
        got = stage(spark, docs, small)
        assert name == "bpe" or (got.columns == docs.columns and all(r[n] == f"kept {n}" for r in got.collect() for n in names)), name
        assert got.count()


def test_pipeline_runs_whole(spark, small):
    import corpus_pipeline as C

    got = C.run(spark, small).collect()
    assert got and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} == set(got[0].asDict())
