"""Operator 11, ranked lexical search: dual-tree search for each item's best documents, exactly.

An item is a vector of term weights, a document one of term impacts, and a score their
product.  Items and documents are put into hierarchies whose nodes hold the maximum of each
coordinate below them: the product of two nodes' maxima bounds every score between them.
Both hierarchies are walked together, level by level; a pair of nodes goes on only while
its bound reaches the weakest k-th score of the items below.  What is left at the leaves is
scored in full.  All numbers are integers, exact in doubles up to ``EXACT`` and 64-bit beyond.

The search runs in four steps:

1. one pass over the texts leaves each document's number of terms and its counts of the
   items' terms; number of documents, all terms and document frequencies are sums over that;
2. each item's k-th score among ``SEEDS`` documents bounds it from below (any documents would do);
3. each task goes over its documents in blocks, a tree for each, ordered by the group of
   items that suits a document best, and keeps the best k of each item;
4. the tasks' lists are merged, at most k rows per item and task.

Items come in groups of ``ITEMS`` (rows with one ``item_id`` are one item, whose terms are those of all
of them), each group being searched in all documents: what is sent to tasks or brought to
the driver depends on one group's texts only.  Documents are dealt as they lie; a block is one
matrix of ``BLOCK`` documents by the group's terms.

Null texts and texts without terms rank nowhere; empty items, and items none of whose terms
occur, get no rows; repeated rows of a document are each ranked; a null ``doc_id`` comes
first among equals, null ``item_id``s are one item; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulse.llm.common import read_table, write_shared

TOP = 20
ITEMS = 512                    # items searched at a time
SEEDS = 2048                   # documents that give the first lower bounds
BLOCK, LEAF_DOCS, LEAF_ITEMS = 1024, 32, 4
EXACT = 1 << 53

# A term byte is a digit, a letter (A-Z lower-cased) or part of a character beyond ASCII.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# ---- items -----------------------------------------------------------------------------------

class Items:
    """A group of items as a matrix over their terms, and the hierarchy over them.

    ``levels``: from the root down, per level the nodes as ranges of ``order`` and their coordinate maxima.
    """

    def __init__(self, items: list[tuple[object, dict[int, int]]], weights: np.ndarray):
        self.matrix = np.zeros((len(items), len(weights)), np.int64)
        for i, (_, counts) in enumerate(items):
            for t, n in counts.items():
                self.matrix[i, t] = n * int(weights[t])
        # an impact is at most 1e6, so no score and no bound passes that times the root's maxima
        if not len(items) or int(self.matrix.max(axis=0, initial=0).sum()) * 1_000_000 < EXACT:
            self.matrix = self.matrix.astype(np.float64)
        self.order = np.array(self._order(np.arange(len(items))), np.int64)
        self.levels = levels(self.matrix, self.order, LEAF_ITEMS)

    def _order(self, rows: np.ndarray) -> list[int]:
        """Items side by side that share weight: halves around two unlike items, again and again."""
        stack, out = [rows], []
        while stack:
            rows = stack.pop()
            if len(rows) <= LEAF_ITEMS:
                out += rows.tolist()
                continue
            part = self.matrix[rows].astype(np.float64)
            part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1)
            a = int(np.argmin(part @ part[0]))
            b = int(np.argmin(part @ part[a]))
            side = np.argsort(part @ (part[b] - part[a]), kind="stable")
            half = len(rows) // 2
            stack += [rows[side[half:]], rows[side[:half]]]
        return out


def levels(matrix: np.ndarray, order: np.ndarray, leaf: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A binary hierarchy over ``order``: per level, root first, the bounds of its nodes and their coordinate maxima."""
    if not len(order):
        return []
    bounds = np.arange(0, len(order) + leaf, leaf).clip(max=len(order))
    bounds = np.unique(bounds)
    maxima = np.maximum.reduceat(matrix[order], bounds[:-1], axis=0)
    out = [(bounds, maxima)]
    while len(bounds) > 2:
        keep = np.append(bounds[:-1:2], bounds[-1])
        maxima = np.maximum.reduceat(maxima, np.arange(0, len(maxima), 2), axis=0)
        bounds = keep
        out.append((bounds, maxima))
    return out[::-1]


# ---- the walk over both hierarchies -------------------------------------------------------------------

class Search:
    """The best documents of each item so far, and the walk that adds a block of documents."""

    def __init__(self, items: Items, floor: np.ndarray, top: int):
        self.items, self.top = items, top
        self.floor = np.maximum(floor, 1)                     # no score below can be among the best; 0 never is
        n = len(items.matrix)
        self.scores, self.docs = [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n
        self.bounded = self.scored = 0

    def _weakest(self, bounds: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(self.floor[self.items.order], bounds[:-1])

    def add(self, docs: np.ndarray, impacts: np.ndarray) -> None:
        """Rank a block: document ids and their impacts (documents by terms)."""
        if not len(docs) or not self.items.levels:
            return
        impacts = impacts.astype(self.items.matrix.dtype)
        # documents in the order of the group of items that they suit best, the best ones first
        groups = self.items.levels[min(4, len(self.items.levels) - 1)][1]
        suits = impacts @ groups.T
        best = suits.argmax(axis=1)
        order = np.lexsort((-suits[np.arange(len(docs)), best], best))
        tree = levels(impacts, order, LEAF_DOCS)
        # both roots first; then each level of either, the shorter hierarchy waiting at its leaves
        alive, ni, nd, depth_i, depth_d = np.ones((1, 1), bool), len(self.items.levels), len(tree), 0, 0
        while True:
            bounds_i, max_i = self.items.levels[depth_i]
            bounds_d, max_d = tree[depth_d]
            rows, cols = alive.any(axis=1), alive.any(axis=0)
            if not rows.any():
                return
            bound = np.zeros(alive.shape, max_i.dtype)
            bound[np.ix_(rows, cols)] = max_i[rows] @ max_d[cols].T
            self.bounded += int(rows.sum()) * int(cols.sum())
            alive &= bound >= self._weakest(bounds_i)[:, None]
            if depth_i + 1 == ni and depth_d + 1 == nd:
                break
            if depth_i + 1 < ni:
                depth_i += 1
                alive = np.repeat(alive, 2, axis=0)[:len(self.items.levels[depth_i][1])]
            if depth_d + 1 < nd:
                depth_d += 1
                alive = np.repeat(alive, 2, axis=1)[:, :len(tree[depth_d][1])]
        # leaves with the highest bounds first: they raise the k-th scores that the others are held against
        for d in np.argsort(-bound.max(axis=0), kind="stable"):
            groups = np.flatnonzero(alive[:, d] & (bound[:, d] >= self._weakest(bounds_i)))
            if not len(groups):
                continue
            rows = order[bounds_d[d]:bounds_d[d + 1]]
            chosen = np.concatenate([self.items.order[bounds_i[g]:bounds_i[g + 1]] for g in groups])
            found = (self.items.matrix[chosen] @ impacts[rows].T).astype(np.int64)
            self.scored += found.size
            for item, scores in zip(chosen, found, strict=True):
                good = np.flatnonzero(scores >= self.floor[item])
                if len(good):
                    self._keep(item, docs[rows[good]], scores[good])

    def _keep(self, item: int, docs: np.ndarray, scores: np.ndarray) -> None:
        docs, scores = np.concatenate([self.docs[item], docs]), np.concatenate([self.scores[item], scores])
        best = np.lexsort((docs, -scores))[:self.top]
        self.docs[item], self.scores[item] = docs[best], scores[best]
        if len(best) == self.top:
            self.floor[item] = max(self.floor[item], scores[best[-1]])


# ---- documents -----------------------------------------------------------------------------------

_NULL = np.iinfo(np.int64).min                     # stands for a null doc_id in a task: first among equals


def counted(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs: each document's number of terms, and how often it has the items' ones."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)        # the terms of one group of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column(1):
                all_terms = terms_of(text.as_py())
                counts = Counter(filter(known.__contains__, all_terms))
                n.append(len(all_terms))
                terms.append([known[t] for t in counts])
                tfs.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                                              pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def impacts(batch: pa.RecordBatch, n_terms: int, n_docs: int, n_all: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of document ids and impacts of a batch of counted documents."""
    ids = batch.column(0).fill_null(_NULL).to_numpy(zero_copy_only=False)
    # m = 75 + (25 n N) div L, in Python's numbers: the product can pass 64 bits
    m = np.array([100 - 25 + 25 * n * n_docs // n_all for n in batch.column(1).to_pylist()], np.int64)
    terms, tfs = batch.column(2), batch.column(3)
    for a in range(0, len(ids), BLOCK):
        t, f = terms.slice(a, BLOCK), tfs.slice(a, BLOCK)
        sizes = np.diff(t.offsets.to_numpy())
        rows = np.repeat(np.arange(len(t)), sizes)
        tf = f.flatten().to_numpy().astype(np.int64)
        block = np.zeros((len(t), n_terms), np.int64)
        block[rows, t.flatten().to_numpy()] = (1_000_000_000 * tf) // (1000 * tf + 12 * m[a:a + BLOCK][rows])
        yield ids[a:a + BLOCK], block


_FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def best_of_tasks(docs: DataFrame, items: Items, floor: np.ndarray, stats: tuple[int, int], top: int) -> DataFrame:
    """item (place in the group), doc_id, score: the best ``top`` of each item among each task's documents."""
    sent = docs.sparkSession.sparkContext.broadcast((items, floor, stats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floor, (n_docs, n_all) = sent.value
        search = Search(items, floor.copy(), top)
        for batch in batches:
            for ids, block in impacts(batch, items.matrix.shape[1], n_docs, n_all):
                search.add(ids, block)
        sizes = [len(d) for d in search.docs]
        if sum(sizes):
            found = np.concatenate(search.docs)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(sizes), dtype="int32"), sizes)),
                                              pa.array(found, pa.int64(), mask=found == _NULL), pa.array(np.concatenate(search.scores))], schema=_FOUND)
    return docs.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item int, doc_id long, score long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, n: the terms of each item, counted before they are shuffled."""
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("term"))
            .groupBy("item_id", "term").agg(F.count("*").alias("n")))


def search_group(documents: DataFrame, items: list[tuple[int | None, dict[bytes, int]]], top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score for one group of items (id and counts of terms)."""
    spark = documents.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(terms for _, terms in items))))}
    docs = write_shared(counted(documents, vocabulary), "counted")
    n_docs, n_all = docs.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in docs.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect():      # one row per term of the group
        weights[term] = weight(n_docs, df)
    group = Items([(i, {vocabulary[t]: n for t, n in terms.items()}) for i, terms in items], weights)
    live = docs.filter(F.size("terms") > 0)
    stats, floor = (n_docs, n_all or 1), np.ones(len(items), np.int64)
    if n_docs > SEEDS:
        seeds = ranked(best_of_tasks(live.limit(SEEDS), group, floor, stats, top), top).filter(F.col("rank") == top)
        for item, score in seeds.select("item", "score").collect():
            floor[item] = score
    best = ranked(best_of_tasks(live, group, floor, stats, top), top)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], "item int, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")      # a name per item of the group


def ranked_search(documents: DataFrame, items: DataFrame, top: int = TOP, group: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` best documents, groups of items one after the other."""
    spark = documents.sparkSession
    counts = write_shared(item_terms(items), "item-terms")
    out, rest = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long"), counts
    while ids := [r[0] for r in rest.select("item_id").distinct().orderBy(F.asc_nulls_first("item_id")).limit(group).collect()]:
        after = F.col("item_id").isNotNull() if ids[-1] is None else F.col("item_id") > ids[-1]
        terms: dict[int | None, dict[bytes, int]] = {i: {} for i in ids}
        for i, term, n in rest.filter(~F.coalesce(after, F.lit(False))).collect():
            terms[i][term.encode()] = n
        out = out.union(write_shared(search_group(documents, list(terms.items()), top), "ranked"))
        rest = counts.filter(after)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked for every benchmark item."""
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
