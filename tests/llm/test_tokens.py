"""The automaton, its arcs and the id files, against the library and arc-by-arc construction."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockloom.llm import bpe, idstore

STRANGE = [
    "", "  ", "Hello World's I'm 123 they'll <|endoftext|>foo<|startoftext|>", "ΣΑΣ ΟΔΟΣ İstanbul ǅ é x́ y", "日本語テキスト 漢字", "\x00\x01\x1c\x1da\x85b", "a" * 3000, "'s't're " * 5, "🙂👩‍👩‍👧", "ﬁ ½ Ⅷ ١٢٣", "<<|endoftext|>>",
    "hahahaha bananana", "!!!!!!!!", "=-=-=", "a\x0bb\x0cc",
]


def brute_bpe(word, merges):
    """Merge the best-ranked pair until none is left."""
    parts = list(word)
    while True:
        found = [(merges[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in merges]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = ["".join(parts[i : i + 2])]


@pytest.mark.parametrize("seed", range(6))
def test_small_automata_agree(seed):
    rng = random.Random(seed)
    tokens, merges = list("abc"), []
    while len(merges) < 14:
        u, v = rng.choice(tokens), rng.choice(tokens)
        if u + v not in tokens:
            merges.append((u, v))
            tokens.append(u + v)
    vocab = {t: i for i, t in enumerate(tokens)}
    lazy, arcs = bpe.Automaton(vocab, merges), bpe.explicit_automaton("abc", merges)
    rank = {m: i for i, m in enumerate(merges)}
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        want = brute_bpe(word, rank)
        assert [tokens[i] for i in lazy.encode(word)] == want
        state = 0
        for t in want:
            assert t in arcs[state]
            state = arcs[state][t]


def test_encoder_is_the_library(tokenizer, documents):
    own, lib = bpe.Encoder(tokenizer), Tokenizer.from_file(tokenizer)
    rng = random.Random(2)
    texts = STRANGE + [r["text"] for r in documents.limit(80).collect()]
    texts += ["".join(chr(rng.choice([rng.randint(32, 0x2FFF), rng.randint(32, 0x17F)])) for _ in range(20)) for _ in range(300)]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(t) == e.ids
        assert own.decode(e.ids) == lib.decode(e.ids, skip_special_tokens=False)


def test_digests(documents, odd, nothing, tokenizer):
    lib = Tokenizer.from_file(tokenizer)
    for df in (documents, odd):
        text = {}
        for r in df.collect():
            text.setdefault(r["doc_id"], r["text"] or "")
        got = bpe.encode_digests(df, tokenizer).collect()
        assert len(got) == df.count()
        for r in got:
            ids = lib.encode(text[r["doc_id"]], add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_digests(nothing, tokenizer).count() == 0
    whole = bpe.encode_documents(odd.where("doc_id = 5"), tokenizer).first()
    assert whole["ids"] == lib.encode("one two", add_special_tokens=False).ids


def test_id_files(documents, odd, nothing, tokenizer, tmp_path):
    lib = Tokenizer.from_file(tokenizer)
    for n, df in enumerate((documents, odd)):
        files = idstore.write(df, tokenizer, str(tmp_path / str(n)), end_id=2)
        got = sorted(idstore.read(files).collect(), key=lambda r: r["start"])
        rows = sorted(df.withColumn("h", F.xxhash64("text")).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
        assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
        start = 0
        for r, d in zip(got, rows, strict=True):
            ids = [*lib.encode(d["text"] or "", add_special_tokens=False).ids, 2]
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    assert idstore.read(idstore.write(nothing, tokenizer, str(tmp_path / "none"), end_id=2)).count() == 0


def test_files_of_a_repeated_id(spark, tokenizer, tmp_path, monkeypatch):
    """Its rows are in several files, the order holds, and a null id is no number."""
    monkeypatch.setattr(idstore, "HOT", 50)
    lowest = -(1 << 63)
    rows = [(5, f"text {i % 100}") for i in range(400)] + [(None, "none"), (lowest, "least")] + [(i, "x") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = idstore.write(df, tokenizer, str(tmp_path / "hot"), end_id=2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(idstore.read(files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, lowest, *sorted(i for i, _ in rows if i is not None and i > lowest)]
    assert files.count() > 1
    idstore.remove(spark, str(tmp_path / "hot"))
    assert not (tmp_path / "hot").exists()


def test_only_asked_frames_are_read(tmp_path, monkeypatch):
    import zstandard

    monkeypatch.setattr(idstore, "FRAME_BYTES", 400)
    w = idstore.Writer(str(tmp_path / "x.zst"))
    docs = {i: np.arange(i, i + 60, dtype="<u4").tobytes() for i in range(50)}
    for i, data in docs.items():
        w.add(i, data)
    w.close()
    r = idstore.Reader(str(tmp_path / "x.zst"))
    assert [data for _, data in r.read([7, 33])] == [docs[7], docs[33]] and r.frames_read == 2 < r.frames
    raw = (tmp_path / "x.zst").read_bytes()
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as whole:
        assert whole.read().startswith(b"".join(docs.values()))
    damaged = bytearray(raw)
    damaged[30] ^= 1
    (tmp_path / "y.zst").write_bytes(damaged)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(idstore.Reader(str(tmp_path / "y.zst")).read())
    (tmp_path / "z.zst").write_bytes(b"short")
    with pytest.raises(ValueError):
        idstore.Reader(str(tmp_path / "z.zst"))


def test_the_table_of_words_may_be_small(tokenizer, monkeypatch):
    monkeypatch.setattr(idstore, "WORDS_HELD", 5)
    monkeypatch.setattr(idstore, "TEXT_BYTES", 20)
    lib = Tokenizer.from_file(tokenizer)
    texts = ["one two three", "four five six seven eight nine", "one", None, "ten eleven"]
    want = [np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts]
    assert list(idstore.encoded([None if t is None else t.encode() for t in texts], tokenizer, 2)) == want


def test_words_of_every_kind_are_the_librarys(tokenizer):
    """Words put together from pieces and words told apart by places, each alone and all in one text."""
    lib, rng = Tokenizer.from_file(tokenizer), random.Random(7)
    kinds = ["'s 't 're 've 'm 'll 'd 'S'T 'RE don't DON'T x'lls '' ''s 's's 'dd'd 'r 'v'e", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> <|endoftext| |>", "ÀÖØÞß ſt ŉ ĸ Ÿ İi ı Ĳ ×÷ a×b", "12 1a2 a,1.b ½ ٣ a_b __", "\x7f \x1cx\x1d a\u0301b \u0301 e\u0301'S ＡＢ \u00a0x\u00a0 \x85", "mail1.00@a.example.com https://x.y/?q=%20&z#-- ,,,$$$ a\x00b"]
    letters = ["'", "s", "S", "re", "LL", "9", ".", ",<|", "|>", "é", "É", "ſ", "Ł", "ß", "\u0301", "日", " ", " ", "\x0b", "\n", "endoftext", "_"]
    texts = STRANGE + kinds + [w for k in kinds for w in k.split()] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    want = [np.array([*e.ids, 2], "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    idstore._words.cache_clear()
    assert list(idstore.encoded([t.encode() for t in texts], tokenizer, 2)) == want
    assert list(idstore.encoded([" ".join(texts).encode()], tokenizer, 2)) == [b"".join(w[:-4] for w in want) + want[0][-4:]]
    assert list(idstore.encoded([None, b"", b" \n "], tokenizer, 2)) == [want[0][-4:]] * 3
    assert list(idstore.encoded([], tokenizer, 2)) == []


def test_a_piece_goes_to_the_library_once(tokenizer, monkeypatch):
    """However many words hold it, in whatever case and with whatever marks; a full table of pieces is emptied."""

    class Counted:
        def __init__(self, of):
            self.of, self.given = of, []

        def encode(self, text, **how):
            self.given += text.split()
            return self.of.encode(text, **how)

        def encode_batch_fast(self, texts, **how):
            self.given += [w for t in texts for w in t.split()]
            return self.of.encode_batch_fast(texts, **how)

    idstore._words.cache_clear()
    words = idstore._words(tokenizer)
    monkeypatch.setattr(words, "of", Counted(words.of))
    marks = [",", ".", "!!", "$$$"]
    for text in ("alpha Alpha ALPHA " + " ".join(f"{w}{m}" for w in ("alpha", "Größe") for m in marks), "größe, ALPHA! (alpha)"):
        list(idstore.encoded([text.encode()], tokenizer, 2))
    assert sorted(words.of.given) == sorted(["alpha", "größe", *marks, "!", "(", ")"])
    monkeypatch.setattr(idstore, "PIECES_HELD", 3)
    monkeypatch.setattr(idstore, "TOGETHER", 2)
    text = "beta gamma, (delta) alpha; beta:gamma=delta"
    assert list(idstore.encoded([text.encode()], tokenizer, 2)) == [np.array([*words.of.of.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()]
    idstore._words.cache_clear()


def test_a_file_of_another_kind_is_not_cut_into_pieces(tokenizer, tmp_path):
    """Here digits stay together and letters keep their case, so only the library knows the pieces."""
    import json

    with open(tokenizer, encoding="utf-8") as f:
        told = json.load(f)
    told["normalizer"] = {"type": "NFC"}
    told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told), encoding="utf-8")
    lib = Tokenizer.from_file(str(path))
    text = "Alpha 123 a1b2 Größe, don't <|endoftext|>x"
    assert list(idstore.encoded([text.encode()], str(path), 2)) == [np.array([*lib.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()]


def test_a_task_reads_a_file(documents, tokenizer, tmp_path, spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = idstore.write(documents, tokenizer, str(tmp_path / "several"), end_id=2)
    rows = idstore.read(files)
    sizes = rows.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() > 1
    assert sorted(sizes) == sorted(r["docs"] for r in files.collect())
