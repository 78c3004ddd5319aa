import zlib

import pytest
from pyspark.sql import types as T

from pulse.llm import sharding
from pulse.llm.common import read_table

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("size", T.StringType()), T.StructField("row_number", T.StringType())])


def feistel(x, n, seed=sharding.SEED):
    a, b = sharding.radices(n)
    left, right = divmod(x, b)
    for i, (k1, k2, k3) in enumerate(sharding.round_keys(seed)):
        y = (right + k1) % sharding.PRIME
        f = (y * y % sharding.PRIME * ((right + k2) % sharding.PRIME) + k3) % sharding.PRIME
        left, right = right, (left + f) % (a, b)[i % 2]
    return left * b + right


def brute_position(row, n):
    p = feistel(row, n)
    while p >= n:
        p = feistel(p, n)
    return p


@pytest.mark.parametrize("n", [1, 2, 3, 5, 23, 24, 25, 97, 1000, 1023])
def test_permutation_is_a_bijection_and_matches_brute_force(spark, n):
    rows = spark.range(n).select("id", sharding.permuted("id", n).alias("p")).collect()
    assert {r.id: r.p for r in rows} == {i: brute_position(i, n) for i in range(n)}
    assert sorted(r.p for r in rows) == list(range(n))


def test_documents(spark):
    docs = sorted(read_table(spark, SF, "documents").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in sharding.op6_sharding(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, d in enumerate(docs):
        r, raw = got[d.doc_id], (d.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        assert r.slot * sharding.SHARDS + r.shard == brute_position(i, len(docs))


def test_nulls_repeats_clashing_names_and_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_PARTITION", 7)
    rows = [(None, None, "x", "y"), (None, "", "x", "y"), *[(1, "a", "x", "y")] * 40, (2, "é" * 100_000, None, None)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA).repartition(5), shards=5).collect()
    assert sorted(r.slot * 5 + r.shard for r in got) == list(range(43))
    assert sorted(r.size for r in got) == [8, 8] + [9] * 40 + [200_008]
    counts = [sum(r.shard == s for r in got) for s in range(5)]
    assert max(counts) - min(counts) <= 1


def test_empty(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).collect() == []
