"""BPE encoding and decoding by a tokenization automaton.

The merges of a byte-pair vocabulary are compiled into a deterministic automaton over tokens that accepts exactly the
token sequences which the merge rules produce.  It starts as one state with an arc for every base symbol; each merge
(u, v) in turn adds a gadget: the state that u enters is split off and loses its arc v, and every state with an arc u
gets an arc uv to where v led.  The state entered depends only on the token just read, so states are numbered by token.

A gadget takes away one rectangle of the transition table.  Its arc (u, v) goes for u and for all states copied from
u's later: tokens that end with u and are born after the merge.  It goes likewise for v and for all labels that begin
with v and are born with the merge or after it.  Put in pre-order, children of one token from young to old, the states
and the labels of a rectangle are each one run of numbers.  So ``compile_gadgets`` builds the finished table from all
rectangles at once: for each state the sorted runs of labels it has no arc for, 0.9 million of them for 49k merges.
``explicit_automaton`` builds the same automaton arc by arc, for small vocabularies and as the tests' yardstick.

Words, as split by the tokenizer file's own normaliser and pre-tokenizer, are encoded by table-driven transitions in
one pass: each prefix of a word has one accepted path, so at each position there is one state; the labels that can
follow are read off a table of prefixes, and one look at the state's row tells which of them are arcs.  Nothing is
taken back.  Decoding emits the labels of the arcs.  White space separates words and is dropped, which is checked on
the file; so equal words are encoded once and held in a table of bounded size.

Null text is empty and has no ids.  Special tokens that are spelt out in a text become their ids.  Rows are
independent: repeated rows and nulls in other columns change nothing, and a text of any length is encoded whole.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterable
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np

#: Words held by a task's table of encoded words; a full table is emptied.
WORDS_HELD = 100_000
#: Words that go through the automaton together; bounds the arrays (about 150 bytes a symbol).
TOGETHER = 8_000
#: Characters of text whose new words are encoded together.
TEXT_BYTES = 1 << 19


def _pre_order(parent: np.ndarray, birth: np.ndarray) -> tuple[np.ndarray, list[list[int]], np.ndarray]:
    """Places of the tokens of a forest in pre-order, their children from young to old, and the sizes of subtrees."""
    young_first = np.argsort(-birth, kind="stable")
    children: list[list[int]] = [[] for _ in parent]
    size = np.ones(len(parent), np.int64)
    for t in young_first.tolist():
        if parent[t] >= 0:
            children[parent[t]].append(t)
            size[parent[t]] += size[t]
    # A child is younger than its parent: parents get their places first.
    place, free = np.zeros(len(parent), np.int64), 0
    for t in young_first[::-1].tolist():
        if parent[t] < 0:
            place[t], free = free, free + size[t]
        at = place[t] + 1
        for c in children[t]:
            place[c] = at
            at += size[c]
    return place, children, size


def compile_gadgets(size: int, merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The transition table of ``size`` tokens after the merges (u, v, uv), in order.

    Returns the states' and labels' places and the runs of missing arcs as sorted (first, end) of
    ``state's place * size + label's place``; runs of one state do not overlap.
    """
    birth, left, right = (np.full(size, -1, np.int64) for _ in range(3))
    for rank, (u, v, uv) in enumerate(merges):
        birth[uv], left[uv], right[uv] = rank, u, v
    state, by_end, n_end = _pre_order(right, birth)
    label, by_begin, n_begin = _pre_order(left, birth)

    def ends(children: list[list[int]], n: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
        """For each token: minus its children's births, and how many tokens its first children's subtrees hold."""
        births = [[-int(birth[c]) for c in kids] for kids in children]
        return births, [np.concatenate(([0], np.cumsum(n[kids]))).tolist() if kids else [0] for kids in children]

    end_births, end_counts = ends(by_end, n_end)
    begin_births, begin_counts = ends(by_begin, n_begin)
    boxes = np.zeros((len(merges), 4), np.int64)
    for rank, (u, v, _) in enumerate(merges):
        # States copied after the merge, labels added with it or after it.
        states = 1 + end_counts[u][bisect_right(end_births[u], -rank - 1)]
        labels = 1 + begin_counts[v][bisect_right(begin_births[v], -rank)]
        boxes[rank] = state[u], states, label[v], labels
    n = boxes[:, 1]
    row = np.repeat(boxes[:, 0], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = row * size + np.repeat(boxes[:, 2], n)
    end = first + np.repeat(boxes[:, 3], n)
    order = np.argsort(first, kind="stable")
    first, end = first[order], end[order]
    reached = np.maximum.accumulate(end)
    apart = np.concatenate(([True], first[1:] > reached[:-1])) if len(first) else np.zeros(0, bool)
    at = np.flatnonzero(apart)
    return state, label, first[at], reached[np.append(at[1:], len(first)) - 1] if len(at) else end


class Automaton:
    """The compiled merges: ``encode_words`` words' symbols to token ids, ``label`` to spell them out."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = ""):
        self.size = max(vocab.values()) + 1
        self.label = [""] * self.size
        for token, i in vocab.items():
            self.label[i] = token
        numbered = [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges]
        state, self._place, self._first, self._end = compile_gadgets(self.size, numbered)
        self._row = state * self.size
        alive = np.ones(self.size, bool)
        for (u, v, uv), gone in zip(numbered, _gone_before(numbered), strict=True):
            alive[uv] = alive[u] and alive[v] and not gone
        # Labels by their prefixes: a node a prefix, the token that ends there inside a word, and at a word's end.
        nodes = {"": 1}
        inner, last, step = [0, 0], [0, 0], []
        for token, i in vocab.items():
            ended = bool(suffix) and token.endswith(suffix)
            plain = token.removesuffix(suffix) if ended else token
            at = 1
            for j in range(1, len(plain) + 1):
                to = nodes.get(plain[:j])
                if to is None:
                    to = nodes[plain[:j]] = len(inner)
                    inner.append(0)
                    last.append(0)
                    step.append((at, plain[j - 1], to))
                at = to
            if alive[i] and not ended:
                inner[at] = i + 1
            if alive[i] and (ended or not suffix):
                last[at] = i + 1
        self._inner, self._last = np.array(inner, np.int64) - 1, np.array(last, np.int64) - 1
        # The steps from node to node, sorted by node and symbol; node 0 is the end of all labels.
        symbols = sorted({c for _, c, _ in step})
        self._column = np.zeros(max(map(ord, symbols), default=0) + 2, np.int64)
        self._column[[ord(c) for c in symbols]] = np.arange(1, len(symbols) + 1)
        self._symbols = len(symbols) + 1
        start, symbol, to = (list(x) for x in zip(*step, strict=True)) if step else ([], [], [])
        key = np.array(start, np.int64) * self._symbols + self._column[[ord(c) for c in symbol]]
        order = np.argsort(key)
        self._key, self._to = key[order], np.array(to, np.int64)[order]

    def _next(self, node: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The nodes that a symbol leads to, 0 where no label goes on."""
        key = node * self._symbols + column
        at = np.minimum(np.searchsorted(self._key, key), len(self._key) - 1)
        return np.where(self._key[at] == key, self._to[at], 0)

    def leads(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The transition table: whether the states that tokens ``state`` enter have the arcs ``label``."""
        at = self._row[state] + self._place[label]
        k = np.searchsorted(self._first, at, side="right") - 1
        return (k < 0) | (at >= self._end[k]) if len(self._end) else np.ones(len(at), bool)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids on the one accepted path that spells each word, and the words' offsets into them.

        All words go forward together.  First the labels that begin at each position are read off the table of
        prefixes, a symbol a step; then, position by position, the one state there opens its arcs.
        """
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        column = self._column[np.minimum(text, len(self._column) - 1)]
        length = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(length)
        stop = np.repeat(end, length)
        # Places between symbols: a word of n symbols has n + 1 of them.
        shift = np.repeat(np.arange(len(words)), length)
        at = np.arange(len(text))
        node = np.ones(len(text), np.int64)
        since, till, label = [], [], []
        here = at
        while len(at):
            node = self._next(node, column[here])
            live = node > 0
            at, here, node = at[live], here[live] + 1, node[live]
            ends = here == stop[at]
            token = np.where(ends, self._last[node], self._inner[node])
            hit = token >= 0
            since.append(at[hit] + shift[at[hit]])
            till.append(here[hit] + shift[at[hit]])
            label.append(token[hit])
            at, here, node = at[~ends], here[~ends], node[~ends]
        begin = end - length + np.arange(len(words))
        total = len(text) + len(words)
        depth = np.arange(total) - np.repeat(begin, length + 1)
        since, till, label = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (since, till, label))
        order = np.argsort(depth[since], kind="stable")
        since, till, label = since[order], till[order], label[order]
        state, back = np.full(total, -1, np.int64), np.zeros(total, np.int64)
        cuts = np.searchsorted(depth[since], np.arange(int(length.max(initial=0)) + 1))
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            x, y, t = since[a:b], till[a:b], label[a:b]
            if i:
                open_ = state[x] >= 0
                open_ &= self.leads(np.maximum(state[x], 0), t)
                x, y, t = x[open_], y[open_], t[open_]
            state[y], back[y] = t, x
        # The path back from each word's end.
        on_path = np.zeros(total, bool)
        now = (begin + length)[length > 0]
        if (state[now] < 0).any():
            raise ValueError("no accepted path")
        n = np.zeros(len(words), np.int64)
        owner = np.flatnonzero(length > 0)
        while len(now):
            on_path[now] = True
            n[owner] += 1
            now = back[now]
            more = depth[now] > 0
            now, owner = now[more], owner[more]
        return state[on_path], np.concatenate(([0], np.cumsum(n)))

    def encode(self, word: str) -> list[int]:
        return self.encode_words([word])[0].tolist()


def _gone_before(merges: list[tuple[int, int, int]]) -> list[bool]:
    """For each merge: whether an earlier gadget took its arc away, so that its own gadget adds no token.

    An arc is as old as the younger of its state and label, copied from that one's part: so its past is followed from
    part to part, to where it began or was taken.
    """
    birth, left, right = {}, {}, {}
    taken: dict[tuple[int, int], int] = {}
    out = []
    for rank, (u, v, uv) in enumerate(merges):
        s, t, time = u, v, rank
        while not (gone := taken.get((s, t), time) < time):
            a, b = birth.get(s, -1), birth.get(t, -1)
            if a < 0 and b < 0:
                break
            if a > b:
                s, time = right[s], a
            elif b > a:
                t, time = left[t], b + 1
            else:
                s, t, time = right[s], left[t], a
        out.append(gone)
        birth[uv], left[uv], right[uv] = rank, u, v
        taken[u, v] = rank
    return out


def explicit_automaton(symbols: Iterable[str], merges: Iterable[tuple[str, str]]) -> dict[int, dict[str, int]]:
    """The automaton built arc by arc; state 0 is the start.  Its size grows with states times tokens."""
    arcs: dict[int, dict[str, int]] = {0: {s: 0 for s in symbols}}
    for u, v in merges:
        copies: dict[int, int] = {}
        for p in list(arcs):
            q = arcs[p].get(u)
            if q is not None and v in arcs[q]:
                copies.setdefault(q, len(arcs) + len(copies))
        goal = {q: arcs[q][v] for q in copies}
        for q, c in copies.items():
            arcs[c] = {label: to for label, to in arcs[q].items() if label != v}
        for p in list(arcs):
            q = arcs[p].get(u)
            if q in copies:
                arcs[p][u] = copies[q]
                arcs[p][u + v] = goal[q]
    return arcs


def _byte_symbols() -> list[str]:
    """The symbol for each byte: printable ones of Latin-1 stand for themselves, the others for U+0100 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (chr(256 + i) for i in range(256))
    return [chr(i) if i in plain else next(others) for i in range(256)]


class Encoder:
    """Texts to ids and back, as the tokenizer file says."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        splits = [x for x in (told["pre_tokenizer"] or {}).get("pretokenizers", [told["pre_tokenizer"]]) if x and x["type"] == "Split"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or not any(x["behavior"] == "Removed" and x["invert"] for x in splits):
            raise ValueError("not a byte-pair vocabulary whose words white space separates")
        if told["post_processor"] or told["decoder"]:
            raise ValueError("post-processors and decoders are not supported")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        if any(re.search(r"\s", x) for x in self.special):
            raise ValueError("special tokens with white space are not supported")
        self.label = {i: t for i, t in enumerate(self.automaton.label)} | {i: t for t, i in self.special.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        plain = next(x["pattern"].get("Regex", "") for x in splits)
        # The file's pattern for printable ASCII, composed Latin letters, dashes and quotes, which the normaliser only lowers.
        letters = "a-zß-öø-ÿĀ-ſ"
        self._latin = re.compile(plain.replace(r"[\p{L}]+", f"[{letters}]+").replace(r"[\p{N}]", "[0-9]").replace(r"[^\s\p{L}\p{N}]+", f"[^\\s{letters}0-9]+")) if plain.count(r"\p") == 4 else None
        self._is_latin = re.compile("[\t-\r -~À-ÖØ-öø-įı-ſ\u2010-\u2027\u2030-\u205e]*").fullmatch
        self._bytes = {i: c for i, c in enumerate(_byte_symbols()) if chr(i) != c}

    @cached_property
    def _library(self):
        """The library's normaliser and pre-tokenizer, read when a word first needs them: it holds the vocabulary again."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def symbols(self, piece: str) -> str:
        """A normal piece as the symbols of its bytes."""
        return piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._bytes)

    def pieces(self, text: str) -> Iterable[str | int]:
        """The pieces of a text: normal ones; symbols, marked by a zero in front, of those that only the library
        normalises; ids of special tokens."""
        if self._special and "<" in text and self._special.search(text):
            return [x for part in self._special.split(text) if part for x in ([self.special[part]] if part in self.special else self.pieces(part))]
        if self._latin and self._is_latin(text):
            return self._latin.findall(text.lower())
        words = text.encode("utf-8", "surrogatepass").split()
        if len(words) > 1:
            return [x for w in words for x in self.pieces(w.decode("utf-8", "surrogatepass"))]
        normal = self._library.normalizer.normalize_str(text)
        return ["\0" + p for p, _ in self._library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_pieces(self, pieces: list[str | int]) -> list[list[int]]:
        """The ids of each piece."""
        out = []
        for i in range(0, len(pieces), TOGETHER):
            some = pieces[i : i + TOGETHER]
            words = ["" if isinstance(p, int) else p[1:] if p[0] == "\0" else self.symbols(p) for p in some]
            ids, at = self.automaton.encode_words(words)
            ids, at = ids.tolist(), at.tolist()
            out += [[p] if isinstance(p, int) else ids[a:b] for p, a, b in zip(some, at[:-1], at[1:], strict=True)]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.encode_pieces(list(self.pieces(text or ""))) for i in ids]

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the arcs, joined by a space as the library joins tokens without a decoder."""
        return " ".join(self.label[i] for i in ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process: compiling takes about a second."""
    return Encoder(path)


class _Pieces(dict):
    """Piece -> (its ids in decimal, its labels), each id and label followed by a space."""

    def __init__(self, path: str):
        self.of = encoder(path)
        self.number = [b"%d " % i for i in range(self.of.automaton.size + len(self.of.special))]
        self.spelt = [self.of.label.get(i, "").encode() + b" " for i in range(len(self.number))]

    def learn(self, pieces: Iterable[str | int]) -> None:
        """Encodes the pieces that are not known yet, together."""
        new = set(pieces).difference(self)
        if len(self) + len(new) > WORDS_HELD:
            self.clear()
            new = set(pieces)
        new = list(new)
        number, spelt = self.number.__getitem__, self.spelt.__getitem__
        self.update((p, (b"".join(map(number, ids)), b"".join(map(spelt, ids)))) for p, ids in zip(new, self.of.encode_pieces(new), strict=True))


def encode_documents(docs, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """Per row: id, ids (array of int) and decoded text."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from blockloom.llm.cluster import tidy

    def run(batches):
        of = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [of.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([of.decode(x) for x in ids], pa.string())], names=["id", "ids", "decoded"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(tidy(run), "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encode_digests(docs, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """Per row: id, n_tokens, and the SHA-256 of the decimal ids joined by a space and of the decoded text; the ids
    and texts themselves, which are larger than the input, never leave the task."""
    import hashlib

    import pyarrow as pa
    from pyspark.sql import functions as F

    from blockloom.llm.cluster import tidy

    def digest(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(batches):
        # A table for the task: a worker that goes on to other work holds none.
        known = _Pieces(path)
        get, pieces = known.__getitem__, known.of.pieces
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < batch.num_rows:
                # As many whole texts as make up a few megabytes; their new pieces are encoded together.
                held, size, start = [], 0, at
                while at < batch.num_rows and size < TEXT_BYTES:
                    t = texts[at].as_py() or ""
                    held.append(list(pieces(t)))
                    size += len(t)
                    at += 1
                known.learn(list(chain.from_iterable(held)))
                n, ids, spelt = [], [], []
                for text in held:
                    found = list(map(get, text))
                    told = b"".join([x[0] for x in found])
                    n.append(told.count(b" "))
                    ids.append(digest(told[:-1]))
                    spelt.append(digest(b"".join([x[1] for x in found])[:-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, at - start), pa.array(n, pa.int64()), pa.array(ids), pa.array(spelt)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        known.clear()

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(tidy(run), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
