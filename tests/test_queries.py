"""The registered queries against their SQL, and the entry module."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from shoal.queries import Q, SQL

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def tidy(v):
    return ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = Q[name](spark, SF)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(tidy, r)) for r in cur.fetchall())
    assert sorted(tuple(map(tidy, r)) for r in df.select(*names).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(Q) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
