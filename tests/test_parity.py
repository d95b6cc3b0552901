"""Every query with SQL gives the same rows as DuckDB on the smallest test data."""

import glob
import os

import duckdb
import pytest

from scholiast import catalog
from tests.run_query import normal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert normal(df.collect(), df.columns) == normal(cur.fetchall(), cols)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    df.count()
