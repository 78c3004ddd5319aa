"""Every registered query against its DuckDB oracle on the smallest tables."""

import duckdb
import pytest

from conftest import SF_SMALL
from tools.compare import TABLES, digest, duck_type, spark_types

import __spark_entry__ as se
from pulse.plans.catalog import QUERIES
from pulse.plans.oracle import ORACLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(se.queries()) and ORACLE.items() <= se.oracle_sql().items()


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.columns == ["hashtag", "cnt"] and df.count() == 10


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(ORACLE[name])
    assert spark_types(df.schema) == {c: duck_type(t) for c, t in zip(rel.columns, rel.types)}
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]
