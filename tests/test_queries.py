"""Every query with SQL against DuckDB on the smallest tables; the others by rows."""

import math

import duckdb
import pytest

from tidewater import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    return f"{float(v):.6g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, sf, con, name):
    got = plans.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    cur = con.execute(plans.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_gives_rows(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0
