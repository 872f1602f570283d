"""Every registered query that has SQL gives the rows that DuckDB gives."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from voxmill.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, DATA)
    mine = Counter(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    found = db.sql(registry.ORACLES[name])
    columns = list(found.columns)
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in sorted(columns)]
    assert mine == Counter(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
