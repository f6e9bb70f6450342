"""Registered media queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from framewise.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in ("orders", "lineitem", "customer", "events", "embeddings"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, db, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), db.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = lambda d: sorted(map(str, d[cols].itertuples(index=False, name=None)))
    got = got.astype({c: want[c].dtype for c in cols if got[c].dtype.kind in "if" and want[c].dtype.kind in "if"})
    assert key(got) == key(want)
