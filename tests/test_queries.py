"""Every registered query of the library against its SQL, on the smallest of the driver's tables where they are there."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest
from larkspur.plans.registry import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows) -> list[tuple]:
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
            return "~"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        return f"{float(v):.6f}" if hasattr(v, "__float__") and not isinstance(v, str) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    got = queries()[name](spark, DATA)
    want = duck.sql(oracle_sql()[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert plain(got.select(*names).collect()) == plain(want[names].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql(spark, name):
    assert queries()[name](spark, DATA).count() > 0
