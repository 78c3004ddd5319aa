import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.llm import ann as op
from pulse.llm.common import read_table

SF = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("cell", T.StringType()), T.StructField("score", T.StringType())])


def brute(rows, asked, k=5):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in sorted(i for i in good if asked(i)):
        scores = sorted((-float((good[q] * v).sum() / (np.sqrt((good[q] ** 2).sum()) * np.sqrt((v * v).sum()))), i)
                        for i, v in good.items() if i != q)
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def recall(got, want):
    by = {}
    for r in got:
        by.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert by.keys() <= want.keys()
    for q, ranks in by.items():
        assert sorted(ranks) == list(range(1, len(want[q]) + 1))
        pairs = [ranks[i] for i in sorted(ranks)]
        assert pairs == sorted(pairs, key=lambda p: (-p[1], p[0]))
    hits = sum(len({v for v, _ in by.get(q, {}).values()} & {v for v, _ in w}) for q, w in want.items())
    return hits / max(1, sum(map(len, want.values())))


def test_quantile_and_tree():
    assert abs(op.chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(op.chi_square_quantile(0.5, 2) - 1.3863) < 1e-3
    rng = np.random.default_rng(1)
    points = rng.standard_normal((500, 4))
    tree = op.KdTree(points, 10)
    assert sorted(tree.order) == list(range(500))
    for start, end, left, _ in tree.nodes:
        assert left >= 0 or end - start <= 10
    cells = op.Cells(points, 8)
    assert len(cells.boxes) == 8
    at = cells.of(points)
    assert ((points >= cells.low[at]) & (points <= cells.high[at])).all()


def test_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in read_table(spark, SF, "embeddings").collect()]
    want = brute(rows, lambda i: i % 50 == 0)
    got = op.op2_ann(spark, SF).collect()
    exact = {(q, v): s for q, w in want.items() for v, s in w}
    assert recall(got, want) >= 0.95
    assert all(abs(exact[r.query_id, r.vec_id] - r.score) < 1e-12 for r in got if (r.query_id, r.vec_id) in exact)


def test_many_cells_and_a_dense_spot(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_ROWS", 64)
    monkeypatch.setattr(op, "LEAF", 8)
    monkeypatch.setattr(op, "SAMPLE_ROWS", 400)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 24))
    rows = [centres[rng.integers(20)] + 0.3 * rng.standard_normal(24) for _ in range(900)]
    rows += [centres[0] + 1e-3 * rng.standard_normal(24) for _ in range(300)] + [centres[1]] * 40
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    docs = spark.createDataFrame([(*r, "c", "s") for r in rows], SCHEMA).repartition(5)
    got = op.nearest(docs, F.col("vec_id") % 20 == 0).collect()
    assert recall(got, brute(rows, lambda i: i % 20 == 0)) >= 0.95


def test_nulls_odd_vectors_ties_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]),
            (7, [None, 1.0]), (None, [1.0, 0.0]), (50, [float("inf"), 0.0]), (100, [1.0, 1.0]), (9, [1.0, 0.0, 0.0])]
    docs = spark.createDataFrame([(*r, "c", "s") for r in rows], SCHEMA)
    got = [tuple(r) for r in op.nearest(docs, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    half = 1 / np.sqrt(2)
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (0, 4, 3),
                                                (100, 1, 0), (100, 2, 1), (100, 3, 2), (100, 4, 3)]
    assert np.allclose([s for *_, s in got], [1, 1, half, 0, half, half, half, half])
    assert op.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []
    assert op.nearest(docs.filter("vec_id = 0"), F.lit(True)).collect() == []


def test_every_length_is_searched_and_any_size_of_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(120)] + [(1000 + i, rng.standard_normal(6).tolist()) for i in range(12)] + [(2000, [1.0])]
    for i, v in rows[:60]:
        rows.append((3000 + i, [x * 1e-200 if i % 2 else x * 1e200 for x in v]))
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    got = op.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % 10 == 0).collect()
    fair = [(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows]
    want = {}
    for dims in (8, 6, 1):
        want |= brute([r for r in fair if len(r[1]) == dims], lambda i: i % 10 == 0)
    assert recall(got, {q: w for q, w in want.items() if w}) >= 0.95
    assert {r.query_id for r in got} == {q for q, w in want.items() if w} and all(np.isfinite(r.score) for r in got)
    exact = {(q, v): s for q, w in want.items() for v, s in w}
    assert all(abs(exact[r.query_id, r.vec_id] - r.score) < 1e-12 for r in got if (r.query_id, r.vec_id) in exact)
