"""Every registered query against its SQL in DuckDB over the smallest test tables."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, list):
        return tuple(map(plain, v))
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, str):
        return v
    x = float(v)
    return None if math.isnan(x) else round(x, 6) + 0.0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    c = duck.execute(SQL[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == cols
    at = [names.index(x) for x in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in c.fetchall()), key=repr)
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    df = entry.entry(spark)
    assert "rrf_score" in df.columns and df.count() >= 0
