import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulse.llm import ranked_search as rs
from pulse.llm.common import read_table, with_package
from pulse.llm.ranked_search import Items, Search, item_terms, ranked_search, terms_of

SF = "/root/testdata/sf0.001"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, top=20):
    counts = [(d, Counter(t), len(t)) for d, t in ((d, plain_terms(x)) for d, x in docs) if t]
    n_docs, n_all = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, Counter()).update(plain_terms(text))
    out = []
    for i, q in wanted.items():
        scores = []
        for d, c, n in counts:
            m = 100 - 25 + (25 * n * n_docs) // n_all
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, k in q.items() if t in c)
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        out += [(i, r, d if there else None, -s) for r, (s, there, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def got_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def words(rng, n, size=60):
    return " ".join(rng.choice(("w", "W", "é", "漢"))[0] + str(int(size * rng.random() ** 2)) for _ in range(n))


def test_terms():
    text = "Ab-cd_É9 x\x7fy\x00İ 漢字…!　z\t'tis"
    assert [t.decode() for t in terms_of(text)] == plain_terms(text)
    assert terms_of(None) == terms_of("") == terms_of(" \n-!") == []


def test_items_terms_on_the_jvm_are_the_same(spark):
    rows = [(1, "Ab-cd_É9 x\x7fy ab İ 漢字…!　z\t'tis AB"), (1, "ab"), (2, None), (None, "q"), (3, "!!")]
    got = {(r.item_id, r.term): r.n for r in item_terms(spark.createDataFrame(rows, "item_id long, text string")).collect()}
    want = Counter((i, t) for i, x in rows for t in plain_terms(x))
    assert got == dict(want)


@pytest.mark.parametrize("block, leaf_docs, leaf_items, group, seeds", [(1024, 32, 4, 512, 2048), (16, 3, 2, 7, 30), (7, 1, 1, 1, 5)])
def test_ranks_equal_brute_force_for_any_tree(spark, monkeypatch, block, leaf_docs, leaf_items, group, seeds):
    with_package(spark)
    rng = random.Random(block)
    docs = [(i, words(rng, rng.choice([0, 1, 5, 30, 200]))) for i in range(150)]
    docs += [(500 + i, docs[3][1]) for i in range(40)] + [(None, docs[3][1]), (3, docs[3][1]), (900, None), (901, ""), (902, "w1 " * 50_000)]
    items = [(i, words(rng, rng.choice([1, 4, 20]))) for i in range(15)] + [(20, None), (21, ""), (22, "absent"), (23, "w1 w1 w1"), (23, "w2"), (None, "w3")]
    for name, value in (("BLOCK", block), ("LEAF_DOCS", leaf_docs), ("LEAF_ITEMS", leaf_items), ("SEEDS", seeds)):
        monkeypatch.setattr(rs, name, value)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("score", F.lit("x")).withColumn("terms", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x"))
    if group > 1:
        assert got_of(ranked_search(d, b, group=group)) == brute(docs, items)
    else:
        few = [(None, "w3"), (4, "w5 w1"), (5, "w5 w1")]
        assert got_of(ranked_search(d, spark.createDataFrame(few, "item_id long, text string"), group=1)) == brute(docs, few)


def test_numbers_beyond_doubles_are_64_bit():
    weights = np.array([10_000_000_000, 7], np.int64)
    items = Items([(1, {0: 3, 1: 1})], weights)
    assert items.matrix.dtype == np.int64
    search = Search(items, np.ones(1, np.int64), 2)
    search.add(np.array([5, 6, 4]), np.array([[500_001, 1], [500_001, 2], [500_001, 1]], np.int64))
    assert search.docs[0].tolist() == [6, 4] and search.scores[0][0] == 3 * 10**10 * 500_001 + 14


def test_pairs_of_nodes_are_pruned():
    rng, weights = np.random.default_rng(1), np.full(400, 900, np.int64)
    items = Items([(g * 20 + i, {int(t): 1 for t in rng.choice(20, 5, replace=False) + 20 * g}) for g in range(20) for i in range(20)], weights)
    search, full = Search(items, np.ones(400, np.int64), 5), 0
    for block in range(4):
        topic, x = rng.integers(0, 20, 1000), np.zeros((1000, 400), np.int64)
        for d in range(1000):
            x[d, 20 * topic[d]:20 * topic[d] + 20] = rng.integers(0, 10_000, 20)
        search.add(np.arange(1000) + 1000 * block, x)
        full += 400 * 1000
    assert search.scored < full / 5


def test_edge_tables(spark):
    with_package(spark)
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert got_of(ranked_search(docs.limit(0), items)) == [] and got_of(ranked_search(docs, items.limit(0))) == []
    assert got_of(ranked_search(docs, items)) == brute([(1, "a b")], [(1, "a")])


def test_query_equals_brute_force(spark):
    rows = lambda t, c: [tuple(r) for r in read_table(spark, SF, t).select(c, "text").collect()]
    assert got_of(rs.op11_ranked_search(with_package(spark), SF)) == brute(rows("documents", "doc_id"), rows("benchmark", "item_id"))
