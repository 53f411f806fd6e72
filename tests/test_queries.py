"""Queries with a SQL twin give its rows on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from axonframe.plans import catalog

SF = "/root/testdata/sf0.001"


def cells(frame):
    def cell(v):
        if v is None or v != v:
            return "null"
        return f"{float(v):.5g}" if isinstance(v, (float, np.floating)) else str(int(v)) if isinstance(v, (int, np.integer, bool, np.bool_)) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.SQL:
        want = con.execute(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert cells(got) == cells(want)


def test_rounding_is_that_of_sql(spark, con):
    values = [0.5040625, -0.5040625, 1613 / 3200, 2.5, -2.5, 1e300, 0.49999949999999997, 123456.0000005, float("nan"), float("-inf"), None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["v"] for r in catalog.rounded(rows).collect()}
    for i, v in enumerate(values):
        want = con.execute("select round(?::double, 6)", [v]).fetchone()[0]
        assert got[i] == want or got[i] != got[i] and want != want
