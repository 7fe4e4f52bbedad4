"""Every query with SQL equals DuckDB on the smallest tables; the others run and have rows."""

from __future__ import annotations

import datetime
import os

import pytest

from panelspark import registry

DATA = os.environ.get("PANEL_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't there")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def plain(x):
    if isinstance(x, datetime.datetime):
        return str(x.date())
    return x + 0.0 if isinstance(x, float) else str(x)


def equal(a, b):
    return len(a) == len(b) and all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x)) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if not sql:
        return
    cur = duck.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple(f"{x:.4g}" if isinstance(x, float) else str(x) for x in r)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=key)
    theirs = sorted((tuple(plain(x) for x in r) for r in cur.fetchall()), key=key)
    assert len(mine) == len(theirs)
    assert all(equal(a, b) for a, b in zip(mine, theirs)), next((a, b) for a, b in zip(mine, theirs) if not equal(a, b))
