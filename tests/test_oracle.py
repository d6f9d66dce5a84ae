"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("events", "embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def same(a, b):
    if a is None or b is None:
        return a is b or a != a or b != b
    return math.isclose(a, b, abs_tol=2e-6) if isinstance(a, float) or isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(oracle.statements()))
def test_query_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    names = sorted(got.columns)
    found = con.execute(entry.oracle_sql()[name])
    assert sorted(d[0] for d in found.description) == names
    order = [[d[0] for d in found.description].index(n) for n in names]
    want = sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=lambda r: tuple(str(x) for x in r))
    have = sorted((tuple(r[n] for n in names) for r in got.collect()), key=lambda r: tuple(str(x) for x in r))
    assert len(have) == len(want)
    for x, y in zip(have, want):
        assert all(map(same, x, y)), (x, y)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
