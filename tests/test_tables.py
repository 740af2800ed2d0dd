"""Queries against the SQL beside them, on the smallest tables, where these are there."""

import os

import pytest

from driftwake.plans import more_tables, tables

HOME = "/root/testdata/sf0.001"
NAMES = [n for n in tables.ORACLE if hasattr(more_tables, n)]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(HOME):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{HOME}/{f}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(HOME), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_like_sql(spark, duck, name):
    df = tables.QUERIES[name](spark, HOME)
    rows = duck.execute(tables.ORACLE[name])
    columns = [d[0] for d in rows.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in df.columns) for r in rows.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=str) == want
