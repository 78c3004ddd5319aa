from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import types as T

from pulse.llm import line_dedup as op

SF = "/root/testdata/sf0.001"


def brute(rows, ratio, min_pages):
    pages, on = Counter(r[0] for r in rows), defaultdict(Counter)
    for host, text in rows:
        on[host].update({x.strip(" ") for x in (text or "").split("\n")} - {""})
    bad = {h: {x for x, n in c.items() if n >= min_pages and n > ratio * pages[h]} for h, c in on.items()}
    return [None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in bad[h]) for h, t in rows]


def test_documents_against_sql(spark):
    for t in ("documents",):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(duckdb.sql(op.ORACLE_SQL).fetchall())
    got = sorted(tuple(r) for r in op.op4_line_dedup(spark, SF).collect())
    assert got == want


@pytest.mark.parametrize("limit", [10**6, 0])
def test_hosts_nulls_repeats_and_clashing_names(spark, monkeypatch, limit):
    monkeypatch.setattr(op, "BROADCAST_LINES", limit)
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("text", T.StringType()),
                           T.StructField("line", T.StringType()), T.StructField("n_chars", T.LongType())])
    rows = [("hot", f"menu\n own {i % 3} \nline {i}\n\n  menu") for i in range(60)] + [("hot", "menu")] * 4
    rows += [("b", f"menu\ntext {i}") for i in range(3)] + [(None, f"x{i}\nnull host") for i in range(9)] + [("b", None), ("b", "")]
    rows += [("long", "w " * 100_000 + "\nfoot")] + [("long", f"{i}\nfoot") for i in range(6)]
    docs = spark.createDataFrame([(*r, "clash", -1) for r in rows], schema).repartition(5)
    out = op.drop_boilerplate(docs, length_col="n_chars", ratio=0.5)
    assert out.columns == [*schema.names, "_n_lines", "_n_dropped"]
    got = out.collect()
    assert Counter((r.source, r.text) for r in got) == Counter(zip((r[0] for r in rows), brute(rows, 0.5, 5), strict=True))
    assert all(r.n_chars == (len(r.text) if r._n_dropped else -1) for r in got)
    assert op.line_stage(spark, spark.createDataFrame([], schema), SF).collect() == []
