"""Every query that has SQL gives the same rows in DuckDB over the same tables; the others run."""

import glob
import os

import duckdb
import pytest

from tessella.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def _norm(v):
    return float("%.9g" % v) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(map(_norm, r)) for r in df.select(*cols).collect()), key=str)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(map(_norm, r)) for r in rel.select(*cols).fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(registry.oracle_sql()) <= set(__spark_entry__.oracle_sql())
