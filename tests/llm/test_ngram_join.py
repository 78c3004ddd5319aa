import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from pulse.llm import ngram_join as op
from pulse.llm.common import read_table
from pulse.llm.components import connected_components
from pulse.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    edges = [(i, j) for i in sets for j in sets if i < j and sets[i] and
             100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    comp = union_find(sets, edges)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def as_dict(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_hashed_sets_match_words():
    texts = ["", None, "  \t\n", "a", "A  b", "a b\x0bc d", "x y z x y z x y z", "É é A b c d e", "one " * 5000, "w" * 200_000]
    for width in (1, 4, 5):
        got = [len(s) for s in shingle_sets([None if t is None else t.encode() for t in texts], width)]
        assert got == [len(shingles(t, width)) for t in texts]
    same = list(shingle_sets([b"A b C d e", b"a  B\tc\nD E", b"a b c d f"], 4))
    assert (same[0] == same[1]).all() and len(np.intersect1d(same[0], same[2])) == 1


def test_filters_never_lose_a_link():
    rng = random.Random(5)
    for _ in range(400):
        x = np.array(sorted(rng.sample(range(60), rng.randint(1, 40))), np.uint64)
        y = np.array(sorted(rng.sample(range(60), rng.randint(1, 40))), np.uint64)
        both, either = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        assert op.hamming_at_least(x, y) <= either - both
        x8, y8 = (np.frombuffer(op.parities(v, 16), np.uint8) for v in (x, y))
        assert op._odd(x8, y8) <= either - both
        for percent in (30, 50, 85):
            assert op.links(x, y, percent) == (100 * both >= percent * either)


def test_documents_against_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert as_dict(op.op10_ngram_join(spark, SF)) == brute(rows, 4, 85)
    assert as_dict(op.jaccard_components(docs, width=5, percent=80)) == brute(rows, 5, 80)


@pytest.mark.parametrize("seed", [1, 2])
def test_many_near_copies_and_shared_passages(spark, seed, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_ROWS", 7)
    monkeypatch.setattr(op, "MEMBERS_PER_TASK", 5)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=25)
    rows = []
    for g in range(4):
        base = rng.choices(words, k=40)
        for _ in range(30):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(40)] = rng.choice(words)
            rows.append(t)
    rows += [passage + rng.choices(words, k=rng.randint(0, 8)) for _ in range(40)]
    rows += [passage] * 10 + [["short"], ["short"], ["one", "two"], []]
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert as_dict(op.jaccard_components(docs)) == brute(rows, 4, 85)


def test_nulls_repeats_long_texts_and_clashing_names(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("shingle", T.StringType()), T.StructField("component_id", T.StringType())])
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, "a b c d e", "s", "c"), (1, "a b c d e", "s", "c"), (None, "a b c d e", None, None), (2, None, "s", "c"),
            (3, "", "s", "c"), (5, long, "s", "c"), (4, long + " end", "s", "c")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in
                  op.jaccard_components(spark.createDataFrame(rows, schema)).collect())
    assert got == Counter({(1, 2, 1): 2, (None, 2, None): 1, (2, 0, 2): 1, (3, 0, 3): 1, (5, 29_997, 4): 1, (4, 29_998, 4): 1})
    assert op.jaccard_components(spark.createDataFrame([], schema)).collect() == []
    kept = op.ngram_stage(spark, spark.createDataFrame(rows, schema), SF)
    assert kept.columns == schema.names and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1, 2, 3, 4]


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101 + i) for i in range(60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == union_find({n for e in real for n in e}, real)
