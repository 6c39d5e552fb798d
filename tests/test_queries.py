"""Every registered query with SQL gives the rows that DuckDB gives for it; the others run and have rows."""

import math

import duckdb
import pytest

from textloom.plans import files, pipelines, relational, statistics  # noqa: F401
from textloom.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def order(row):
    return [(x is None, type(x).__name__ if isinstance(x, str) else "", round(x, 4) if isinstance(x, float) else x if x is not None else 0) for x in row]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if name not in SQL:
        assert got
        return
    q = con.execute(SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in q.fetchall()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-6))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 21
    assert set(SQL) <= set(__spark_entry__.queries())
