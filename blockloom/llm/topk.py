"""Exact top-k inner-product search by ball trees, one per shard.

Vectors become integers, floor(scale * x); scores are integer inner products, ties go to the smaller id, and a vector
is never its own result.  The top levels of one tree, built from at most about ``SAMPLE`` vectors, cut the space into
cells; a cell's vectors are a shard, or several by a hash of their id if they are more than ``SHARD``.  Each shard is a
ball tree.  A query descends it by branch and bound: the bound of a node is q.centre + |q| * radius, children are
visited in order of their bound, and a node goes when its bound is below the current k-th score, or equal to it with no
smaller id in the node.  The current k-th score is shared in two rounds: every query searches the shard where it lies
itself first; with the k-th score found there it is sent on only to the shards of cells whose ball, with its true radius
over all vectors, may hold as good a score.

Queries are sent to shards in blocks, so a task holds one tree and one block of queries.  What a shard returns is at
most k rows a query; they are merged by a ranking that keeps k rows at each step.

Vectors that are null, or hold a null or a non-finite component, take no part, nor do those with a null id or with
another number of components than most have (ties: the larger number).  A repeated id is several candidates, and as a
query the smallest vector of that id (in component order) counts.  If no query or fewer than k candidates are there,
there are as many rows as candidates.  Scores outside 64 bits raise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.cluster import cut, runs, tidy

SHARD = 4_096
#: Vectors that the cells are laid out by, and so many of them at least for a cell.
SAMPLE = 16_384
CELL = 32
BLOCK = 512
LEAF = 128


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers held as doubles, exactly: in floating point while all sums stay below 2^53."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    if max(abs(int(x)) for x in whole.ravel()) >= 1 << 63:
        raise OverflowError("a score is outside 64 bits")
    return whole.astype(np.int64)


@dataclass
class Node:
    start: int
    end: int
    centre: np.ndarray
    radius: float
    least: int
    left: Node | None = None
    right: Node | None = None


class BallTree:
    """A shard's vectors (integers as doubles) with their ids; rows are reordered so that a node is a slice."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(ids))
        self._vectors, self._ids, self.leaf = vectors, ids, leaf
        self.root = self._build(0, len(ids))
        self.ids, self.vectors = ids[self.order], vectors[self.order]

    def _build(self, start: int, end: int) -> Node:
        rows = self.order[start:end]
        v = self._vectors[rows]
        centre = v.mean(axis=0)
        away = np.sqrt(((v - centre) ** 2).sum(axis=1))
        # The slack covers what floating point loses.
        node = Node(start, end, centre, float(away.max()) * (1 + 1e-9) + 1e-6, int(self._ids[rows].min()))
        if end - start > self.leaf:
            a = v[int(away.argmax())]
            b = v[int(((v - a) ** 2).sum(axis=1).argmax())]
            # Halves by the projection on the widest pair; equal vectors are halved by id, so the depth is bounded.
            self.order[start:end] = rows[np.lexsort((self._ids[rows], v @ (b - a)))]
            mid = (start + end) // 2
            node.left, node.right = self._build(start, mid), self._build(mid, end)
        return node

    def search(self, query: np.ndarray, own: int | None, k: int, kth: float = -np.inf) -> list[tuple[int, int]]:
        """(score, id) of the best k that score at least ``kth``, best first."""
        norm = float(np.sqrt((query**2).sum()))

        def bound(node: Node) -> float:
            b = float(query @ node.centre) + norm * node.radius
            return b + 1e-9 * abs(b) + 1e-6

        best: list[tuple[int, int]] = []
        stack = [(bound(self.root), self.root)]
        while stack:
            b, node = stack.pop()
            if b < kth or len(best) == k and (b < best[-1][0] or node.least > best[-1][1] and b < best[-1][0] + 1):
                continue
            if node.left is None:
                score = exact_dot(query[None, :], self.vectors[node.start : node.end])[0]
                ids = self.ids[node.start : node.end]
                at = np.flatnonzero((score >= kth) & (ids != own) if own is not None else score >= kth)
                if len(at) > k:
                    at = at[np.lexsort((ids[at], -score[at]))[:k]]
                best = sorted([*best, *zip(score[at].tolist(), ids[at].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
                if len(best) == k:
                    kth = max(kth, best[-1][0])
            else:
                two = sorted(((bound(c), c) for c in (node.left, node.right)), key=lambda x: x[0])
                stack += two
        return best


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _scaled(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    """floor(scale * x); Spark's floor would end at 64 bits."""
    return np.floor(_matrix(column) * scale)


class Cells:
    """The top of a ball tree: halves of halves of a sample, a balanced binary tree in arrays."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.depth = max(0, int(np.log2(max(1, cells))))
        n = (1 << self.depth) - 1
        self.across, self.at = np.zeros((n, sample.shape[1])), np.zeros(n)
        held = {0: sample}
        for node in range(n):
            v = held.pop(node)
            a = v[int(((v - v.mean(axis=0)) ** 2).sum(axis=1).argmax())]
            b = v[int(((v - a) ** 2).sum(axis=1).argmax())]
            along = v @ (b - a)
            self.across[node], self.at[node] = b - a, np.median(along)
            right = along >= self.at[node]
            if right.all():  # equal vectors: any halves will do
                right = np.arange(len(v)) % 2 == 1
            held |= {2 * node + 1: v[~right], 2 * node + 2: v[right]}
        self.centre = np.stack([held[n + i].mean(axis=0) for i in range(1 << self.depth)])

    def of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells that the vectors lie in, and how far they are from the cells' centres."""
        node = np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", vectors, self.across[node]) >= self.at[node])
        cell = node - ((1 << self.depth) - 1)
        return cell, np.sqrt(((vectors - self.centre[cell]) ** 2).sum(axis=1))


def _routed(cells: Cells, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, away = cells.of(_scaled(batch.column(2), scale))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=["id", "asked", "vector", "cell", "away"])

    return run


def _open_cells(cells: Cells, radius: np.ndarray, scale: float):
    """(id, kth, block, home, cell, vector) for the cells that may hold a score as good as a query's k-th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _scaled(batch.column(batch.schema.get_field_index("vector")), scale)
            norm = np.sqrt((q**2).sum(axis=1))
            bound = q @ cells.centre.T + norm[:, None] * radius[None, :]
            bound += 1e-9 * np.abs(bound) + 1e-6
            kth = np.array([-np.inf if x is None else x for x in batch.column(batch.schema.get_field_index("kth")).to_pylist()])
            row, cell = np.nonzero((bound >= kth[:, None]) & (radius >= 0)[None, :])
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    return run


def _search(k: int, scale: float):
    def run(left: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, shard = None, None
        # A shard's rows come first (side 0), then blocks of queries.
        for group in runs(left, ["shard", "side", "block"]):
            at = group.column("shard")[0].as_py()
            ids = group.column("id").to_numpy()
            if group.column("side")[0].as_py() == 0:
                tree, shard = BallTree(ids, _scaled(group.column("vector"), scale)), at
                continue
            if shard != at or tree is None:
                continue
            kth = group.column("kth").to_pylist()
            q, s, v = [], [], []
            for i, vector, least in zip(ids.tolist(), _scaled(group.column("vector"), scale), kth, strict=True):
                for score, x in tree.search(vector, i, k, -np.inf if least is None else least):
                    q.append(i)
                    s.append(score)
                    v.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(s, pa.int64()), pa.array(v, pa.int64())], names=["query_id", "score", "vec_id"])

    return run


def search(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each row where ``is_query`` holds (a column of
    ``id_col``)."""
    v = F.col(vector_col)
    finite = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(finite & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), is_query.alias("asked"), v.cast("array<double>").alias("vector"))
    rows = cut(rows)
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.where(F.size("vector") == size["d"])
    shards = max(1, -(-size["count"] // SHARD))
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) <= int(min(1.0, SAMPLE / size["count"]) * (1 << 20)))
    sample = _scaled(pa.chunked_array([drawn.select("vector").limit(2 * SAMPLE).toArrow().column(0).combine_chunks()]), scale)
    cells = Cells(sample, min(shards, max(1, len(sample) // CELL)))
    routed = cut(rows.select("id", "asked", "vector").mapInArrow(tidy(_routed(cells, scale)), "id long, asked boolean, vector array<double>, cell int, away double"))
    radius, parts = np.full(len(cells.centre), -1.0), np.ones(len(cells.centre), np.int64)
    for r in routed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():
        radius[r["cell"]], parts[r["cell"]] = r["r"] * (1 + 1e-9) + 1e-6, -(-r["n"] // SHARD)
    first_shard = F.array(*[F.lit(int(x)) for x in np.cumsum(parts) - parts])[F.col("cell")]
    n_shards = F.array(*[F.lit(int(x)) for x in parts])[F.col("cell")]
    home = (first_shard + F.pmod(F.xxhash64("id"), n_shards)).cast("int")
    base = routed.select(home.alias("shard"), F.lit(0).alias("side"), F.lit(0).alias("block"), "id", F.lit(None).cast("double").alias("kth"), "vector")
    asked = routed.where("asked").groupBy("id").agg(F.min(F.struct("vector", "cell")).alias("_v")).select("id", "_v.vector", "_v.cell")
    asked = cut(asked.withColumn("home", home).drop("cell"))
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.withColumn("block", 1 + F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int"))
    total = int(parts.sum())

    def found(queries: DataFrame) -> DataFrame:
        both = base.unionByName(queries.select("shard", F.lit(1).alias("side"), "block", "id", "kth", "vector"))
        dealt = both.repartition(total, "shard").sortWithinPartitions("shard", "side", "block", "id")
        return dealt.mapInArrow(tidy(_search(k, scale)), "query_id long, score long, vec_id long")

    # Round one: the shard where the query lies.
    first = cut(found(asked.withColumn("shard", F.col("home")).withColumn("kth", F.lit(None).cast("double"))))
    known = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("kth"))
    rest = asked.join(known, F.col("id") == F.col("query_id"), "left").select("id", "kth", "block", "home", "vector")
    rest = rest.mapInArrow(tidy(_open_cells(cells, radius, scale)), "id long, kth double, block int, home int, vector array<double>, cell int")
    rest = rest.withColumn("shard", F.explode(F.sequence(first_shard, first_shard + n_shards - 1).cast("array<int>"))).where("shard <> home")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    all_found = first.unionByName(found(rest)) if total > 1 else first
    ranked = all_found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
