"""Operator 2, approximate nearest neighbours: stable projections in a kd-tree with a chi-square stop.

Unit vectors are projected to ``PROJECTED`` dimensions by a Gaussian (2-stable) matrix.
For a point at distance d of a query, the squared projected distance over d^2 is
chi-square distributed, so a neighbour that is nearer than the k-th one found (d_k) lies
within the projected radius ``d_k * sqrt(quantile(CONFIDENCE))`` with that confidence.  Points
are verified on the whole vectors in the order of their projected distance until that
radius is passed.

* *Cells.* A kd-tree over the projections of a bounded sample (``SAMPLE_ROWS``) cuts the projected space
  into cells; every vector is indexed in its cell.  A cell with more than ``BLOCK_ROWS``
  vectors is dealt over several blocks by hash, so a dense spot makes more blocks, not a larger one.
* *Round 1.* A query is answered in its own cell, which gives a first d_k.
* *Round 2.* It visits the other cells whose box comes within its radius, with that d_k.

Each block builds its own kd-tree and verifies its leaves in the order of their distance, in growing rounds.  Scores are the measure
itself, in double precision, on the original vectors; ties go to the smaller id.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows without an id.  Vectors of different lengths have no cosine: each length is searched for itself, one
after the other.  Components of any size keep their scores (rows are scaled by powers of two).  A query's own id is never its neighbour; of
several query rows with one id one is asked.  Fewer candidates than ``k`` are all returned.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulse.llm.common import read_table, write_shared
from pulse.llm.vectors import matrix, scaled, unit, usable

K, QUERY_EVERY = 5, 50
PROJECTED, CONFIDENCE, SEED = 8, 0.97, 11      # an even number of dimensions: the chi-square law is a finite sum then
SAMPLE_ROWS, CELL_SAMPLE = 20_000, 8           # sampled rows in all (expected) and per cell at least
BLOCK_ROWS, LEAF = 4_096, 64


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile of the chi-square law with an even number ``m`` of degrees of freedom."""
    def cdf(x):
        term = total = math.exp(-x / 2)
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - total

    low, high = 0.0, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def projection(dims: int, projected: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, projected))


class KdTree:
    """Median splits on the widest dimension; ``boxes`` bound the points of each node."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order, self.nodes = np.arange(len(points)), []     # nodes: (start, end, left, right)
        self.low, self.high = [], []
        if len(points):
            self._build(points, 0, len(points), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, points, start, end, leaf) -> int:
        at = self.order[start:end]
        own, low, high = len(self.nodes), points[at].min(axis=0), points[at].max(axis=0)
        self.nodes.append((start, end, -1, -1))
        self.low.append(low)
        self.high.append(high)
        d = int(np.argmax(high - low))
        if end - start > leaf and high[d] > low[d]:
            mid = (end - start) // 2
            self.order[start:end] = at[np.argpartition(points[at, d], mid)]
            left = self._build(points, start, start + mid, leaf)
            self.nodes[own] = (start, end, left, self._build(points, start + mid, end, leaf))
        return own

    def leaves(self) -> np.ndarray:
        return np.array([i for i, (*_, left, _) in enumerate(self.nodes) if left < 0], np.int64)

    def gaps(self, nodes: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point (rows) to the box of each of some nodes."""
        out = np.zeros((len(points), len(nodes)))
        for d in range(points.shape[1]):
            at = points[:, d:d + 1]
            away = np.maximum(0, np.maximum(self.low[nodes, d] - at, at - self.high[nodes, d]))
            out += away * away
        return out


class Cells:
    """Cells of the projected space: the leaves of a kd-tree of split planes."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.splits, self.boxes = [], []                   # (dimension, value, left, right); cells: ~index
        m = sample.shape[1]
        self.root = self._build(sample, cells, np.full(m, -np.inf), np.full(m, np.inf))
        self.low, self.high = (np.array(x) for x in zip(*self.boxes, strict=True))

    def _build(self, sample, cells, low, high) -> int:
        if cells > 1 and len(sample) >= 2 * CELL_SAMPLE:
            d = int(np.argmax(np.ptp(sample, axis=0)))
            value = float(np.median(sample[:, d]))
            left = sample[:, d] < value
            if left.any():
                own = len(self.splits)
                self.splits.append(None)
                inner_high, inner_low = high.copy(), low.copy()
                inner_high[d] = inner_low[d] = value
                a = self._build(sample[left], cells // 2, low, inner_high)
                self.splits[own] = (d, value, a, self._build(sample[~left], cells - cells // 2, inner_low, high))
                return own
        self.boxes.append((low, high))
        return ~(len(self.boxes) - 1)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out, todo = np.empty(len(points), np.int64), [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = ~node
                continue
            d, value, left, right = self.splits[node]
            side = points[at, d] < value
            todo += [(left, at[side]), (right, at[~side])]
        return out

    def within(self, q: np.ndarray, radius2: float) -> np.ndarray:
        """Cells whose box comes within a squared distance of ``q``."""
        out = np.maximum(0, np.maximum(self.low - q, q - self.high))
        return np.flatnonzero((out * out).sum(axis=1) <= radius2)


class Block:
    """The vectors of one block, searched in the order of projected distance, a round of kd-tree leaves at a time."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, planes: np.ndarray, factor: float):
        projected = unit(vectors) @ planes
        self.tree = KdTree(projected, LEAF)
        order = self.tree.order                            # a leaf's vectors lie side by side
        self.ids, self.vectors, self.projected, self.factor = ids[order], scaled(vectors)[order], projected[order], factor
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.leaves = self.tree.leaves()
        self.spans = [self.tree.nodes[i][:2] for i in self.leaves]

    def search(self, queries: np.ndarray, vectors: np.ndarray, projected: np.ndarray, k: int, bounds: np.ndarray) -> Iterator[list[tuple[float, int]]]:
        """For each query the best (score, id) here, as far as they may beat a k-th squared distance of its bound.

        The leaf nearest in the projection is verified first, then twice as many, and so on; the stopping test is made
        before each round, and single vectors beyond the radius are left out.
        """
        gaps = self.tree.gaps(self.leaves, projected)
        vectors = scaled(vectors)
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        for i, query in enumerate(queries):
            bound, best = float(bounds[i]), []
            order = np.argsort(gaps[i], kind="stable")
            near, n, step = gaps[i][order], 0, 1
            while n < len(order) and near[n] <= bound * self.factor:       # beyond: quantile(CONFIDENCE) is reached
                some = order[n:n + step][near[n:n + step] <= bound * self.factor]
                n, step = n + step, 2 * step
                at = np.concatenate([np.arange(*self.spans[j]) for j in some])
                away = self.projected[at] - projected[i]
                at = at[(np.einsum("ij,ij->i", away, away) <= bound * self.factor) & (self.ids[at] != query)]
                scores = (self.vectors[at] * vectors[i]).sum(axis=1) / (self.norms[at] * norms[i])
                if len(best) == k:                                          # of the rest, only what may enter
                    better = scores >= best[-1][0]
                    at, scores = at[better], scores[better]
                if len(at):
                    best = sorted(best + list(zip(scores.tolist(), self.ids[at].tolist(), strict=True)), key=lambda p: (-p[0], p[1]))[:k]
                    if len(best) == k:
                        bound = min(bound, max(0.0, 2 - 2 * best[-1][0]) + 1e-12)
            yield best


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(dims: int, planes: np.ndarray, factor: float, k: int):
    """Rows sorted by cell, part and role: a block's vectors (role 0), then the queries that visit it (role 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, block = None, [], [], None
        for batch in batches:
            cells, parts, roles = (batch.column(c).to_numpy() for c in ("cell", "part", "role"))
            if not len(cells):
                continue
            own, x, bounds = batch.column("vec_id").to_numpy(), matrix(batch.column("vector"), dims), batch.column("bound").to_numpy()
            edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(parts) != 0) | (np.diff(roles) != 0)) + 1
            rows = []
            for a, b in zip(np.r_[0, edges], np.r_[edges, len(cells)], strict=True):
                if (cells[a], parts[a]) != key:
                    key, ids, vectors, block = (cells[a], parts[a]), [], [], None
                if roles[a] == 0:
                    ids.append(own[a:b])
                    vectors.append(x[a:b])
                    continue
                if not ids:
                    continue
                if block is None:
                    block = Block(np.concatenate(ids), np.concatenate(vectors), planes, factor)
                found = block.search(own[a:b], x[a:b], unit(x[a:b]) @ planes, k, bounds[a:b])
                rows += [(query, v, s) for query, best in zip(own[a:b].tolist(), found, strict=True) for s, v in best]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)],
                                                 schema=_FOUND)

    return run


def _with_cell(dims: int, planes: np.ndarray, cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = cells.of(unit(matrix(batch.column("vector"), dims)) @ planes) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "cell"])
    return run


def _visits(dims: int, planes: np.ndarray, cells: Cells, factor: float):
    """Queries with ``home`` and ``bound``: one row for each other cell within their radius."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = unit(matrix(batch.column("vector"), dims)) @ planes
            home, bound = batch.column("home").to_numpy(), batch.column("bound").to_numpy()
            for i in range(len(q)):
                to = cells.within(q[i], bound[i] * factor)
                to = to[to != home[i]]
                if len(to):
                    one = batch.slice(i, 1).take(pa.array(np.zeros(len(to), np.int64)))
                    yield pa.RecordBatch.from_arrays([one.column("vec_id"), one.column("vector"), one.column("bound"), pa.array(to)],
                                                     names=["vec_id", "vector", "bound", "cell"])
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
            projected: int = PROJECTED, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found by cosine for each row for which ``is_query`` holds."""
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"),
                       F.coalesce(is_query, F.lit(False)).alias("asked"))
    base = base.filter(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    lengths = base.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).orderBy("dims").collect()      # a row per length
    out = base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dims, n in lengths:
        out = out.union(_nearest(base.filter(F.size("vector") == dims), dims, n, k, projected, confidence, seed))
    return out


def _nearest(base: DataFrame, dims: int, n: int, k: int, projected: int, confidence: float, seed: int) -> DataFrame:
    """:func:`nearest` among ``n`` vectors of one length."""
    planes, factor = projection(dims, projected, seed), chi_square_quantile(confidence, projected)
    part = base if n <= SAMPLE_ROWS else base.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1e6 * SAMPLE_ROWS / n))
    sample = matrix(part.select("vector").toArrow().column("vector").combine_chunks(), dims)
    cells = Cells(unit(sample) @ planes if len(sample) else np.zeros((1, projected)), max(1, -(-n // BLOCK_ROWS)))

    placed = write_shared(base.mapInArrow(_with_cell(dims, planes, cells), "vec_id long, vector array<double>, asked boolean, cell long"),
                          "cells")
    counts = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))   # a row per cell
    blocks = placed.join(F.broadcast(counts), "cell").select(
        "cell", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("role"), "vec_id",
        "vector", F.lit(0.0).alias("bound"))
    asked = placed.filter("asked").dropDuplicates(["vec_id"])

    def search(visits: DataFrame) -> DataFrame:
        to = visits.join(F.broadcast(counts), "cell").select(
            "cell", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(1).alias("role"), "vec_id", "vector", "bound")
        together = blocks.union(to).repartition("cell", "part").sortWithinPartitions("cell", "part", "role", "vec_id")
        return together.mapInArrow(_search(dims, planes, factor, k), "query_id long, vec_id long, score double")

    near = write_shared(_best(search(asked.select("cell", "vec_id", "vector", F.lit(float("inf")).alias("bound"))), k).drop("rank"), "near")
    kth = near.groupBy("query_id").agg(F.min("score").alias("last"), F.count("*").alias("n"))
    bounded = asked.join(kth, asked["vec_id"] == kth["query_id"], "left").select(
        "vec_id", "vector", F.col("cell").alias("home"),
        F.when(F.col("n") >= k, F.greatest(F.lit(0.0), 2 - 2 * F.col("last")) + 1e-12).otherwise(F.lit(float("inf"))).alias("bound"))
    visits = bounded.mapInArrow(_visits(dims, planes, cells, factor), "vec_id long, vector array<double>, bound double, cell long")
    return _best(near.union(search(visits)), k).select("query_id", "rank", "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest embeddings of every fiftieth one."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)
