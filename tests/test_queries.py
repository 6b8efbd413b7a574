"""Every query with SQL beside DuckDB on the smallest tables: names of columns, and rows as multisets."""

from __future__ import annotations

import glob
import math
from pathlib import Path

import duckdb
import pytest

from veilframe.plans import queries as plans

DATA = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {Path(p).stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_like_duckdb(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    con = duck.execute(plans.ORACLES[name])
    names = [x[0] for x in con.description]
    assert sorted(df.columns) == sorted(names)
    want = rows(names, con.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
    assert want


def test_flagship(spark):
    assert plans.flagship(spark, DATA).count() > 0
