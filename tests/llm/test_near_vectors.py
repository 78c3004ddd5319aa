import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from pulse.llm import near_vectors as op
from pulse.llm.common import read_table

SF = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("n", T.StringType()), T.StructField("component", T.StringType())])


def brute(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    parent = {i: i for i, _ in good}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    out = {}
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    close = x @ x.T >= threshold
    np.fill_diagonal(close, False)
    for i, j in np.argwhere(close):
        a, b = find(good[i][0]), find(good[j][0])
        parent[max(a, b)] = min(a, b)
    for k, (i, _) in enumerate(good):
        out[i] = (int(close[k].sum()), find(i))
    return {i: (*out.get(i, (0, i)),) for i, _ in rows}


def test_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in read_table(spark, SF, "embeddings").collect()]
    want = brute(rows)
    got = op.op8_near_vectors(spark, SF).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_large_groups_and_block_edges(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 16)
    monkeypatch.setattr(op, "SPAN", 40)
    monkeypatch.setattr(op, "ROWS_PER_PARTITION", 300)
    rng = np.random.default_rng(3)
    rows = []
    for size, noise in ((150, 0.02), (40, 0.04), (3, 0.01)):
        base = rng.standard_normal(16)
        rows += [base + noise * rng.standard_normal(16) for _ in range(size)]
    rows += [rng.standard_normal(16) for _ in range(60)]
    rows += [rows[0]] * 20 + [2 * rows[0]] * 3
    rows = [(int(i), [float(np.float32(x)) for x in rows[k]]) for k, i in enumerate(rng.permutation(len(rows)))]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(6)
    got = {r.vec_id: (r.n_links, r.component_id) for r in op.near_duplicates(docs, window=12).collect()}
    assert got == brute(rows)


def test_nulls_odd_vectors_repeats_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.01]),
            (9, [1e-30, 1e-32]), (10, [1.0, 0.0, 0.0])]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op.near_duplicates(docs).collect()}
    assert got == {**{i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10)}, 7: (2, 7, True), 8: (2, 7, False), 9: (2, 7, False)}
    twice = spark.createDataFrame([(7, [1.0, 0.0], "x", "y")] * 2 + [(None, [1.0, 0.0], "x", "y")], SCHEMA)
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in op.near_duplicates(twice).collect()
                  ) == [(0, 0, None, True), (7, 1, 7, True), (7, 1, 7, True)]
    assert op.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("cosine", [0.95, 0.97])
def test_recall_of_lone_pairs(spark, cosine):
    """Pairs just above the threshold, the hardest to meet, among random vectors."""
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(300):
        a, b = rng.standard_normal((2, 32))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        c = cosine + 0.002
        rows += [a, c * a + np.sqrt(1 - c * c) * b]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    linked = sum(r.n_links > 0 for r in op.near_duplicates(docs, window=16).collect()) / len(rows)
    assert linked > 0.9


def test_every_pair_of_a_dense_group_is_found(spark, tmp_dir):
    """30,000 vectors at a cosine of about 0.85 with each other, some of them in pairs just above the threshold."""
    rng = np.random.default_rng(11)
    n, dims, pairs = 30_000, 64, 300
    centre = rng.standard_normal(dims)
    centre /= np.linalg.norm(centre)
    x = rng.standard_normal((n, dims))
    x -= (x @ centre)[:, None] * centre
    x = np.sqrt(0.85) * centre + np.sqrt(0.15) * x / np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((pairs, dims))
    side -= (side * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x[n - pairs:] = 0.952 * x[:pairs] + np.sqrt(1 - 0.952 ** 2) * side
    order = rng.permutation(n)
    path = f"{tmp_dir}/dense.parquet"
    pq.write_table(pa.table({"vec_id": order, "embedding": pa.array(list(x), pa.list_(pa.float64()))}), path)
    links, parent = np.zeros(n, int), list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for at in range(0, n, 2_000):
        for i, j in np.argwhere(x[at:at + 2_000] @ x.T >= 0.95):
            if i + at != j:
                links[order[j]] += 1
                a, b = find(order[i + at]), find(order[j])
                parent[max(a, b)] = min(a, b)
    got = op.near_duplicates(spark.read.parquet(path)).select("vec_id", "n_links", "component_id").toPandas().set_index("vec_id").sort_index()
    assert links.sum() >= 2 * pairs
    assert (got.n_links.to_numpy() == links).all()
    assert got.component_id.tolist() == [find(i) for i in range(n)]


def test_cells_leave_no_pair_out(spark, monkeypatch):
    """Cells, blocks and visits alone, without passes that find most links, on vectors of two lengths."""
    monkeypatch.setattr(op, "CELL_LEAST", 8)
    monkeypatch.setattr(op, "TILE", 16)
    rng = np.random.default_rng(2)
    rows = []
    for dims, size in ((4, 500), (3, 150)):
        rows += [rng.standard_normal(dims).tolist() for _ in range(size)]
        near = rng.standard_normal(dims)
        rows += [(near + 1e-9 * rng.standard_normal(dims)).tolist() for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id) for r in op.near_duplicates(docs, passes=1, bits=1, window=1, threshold=0.99).collect()}
    want = {}
    for dims in (4, 3):
        want |= brute([(i, v) for i, v in enumerate(rows) if len(v) == dims], 0.99)
    assert got == want
