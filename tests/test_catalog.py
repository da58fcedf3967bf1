"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tidemark.plans.catalog import FLAGSHIP, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        assert not math.isnan(v), "a value that is no number leaves a query as null"
        return round(v, 9)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q[1]])
def test_query_equals_sql(spark, sf, con, name):
    run, sql = QUERIES[name]
    df = run(spark, sf)
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, got.fetchall())


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q[1]])
def test_query_runs(spark, sf, name):
    assert QUERIES[name][0](spark, sf).count() > 0


def test_flagship():
    assert QUERIES[FLAGSHIP][1]
