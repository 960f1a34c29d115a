"""Queries held against their DuckDB statements on the smallest tables."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"


def connection():
    """DuckDB with the tables as views; the test is skipped where they are absent."""
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    """A value in a form that both engines share."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def same(spark, query, sql):
    """Assert equal columns and rows."""
    df = query(spark, SF)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = connection().execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)
    assert ours == theirs
