"""Every named query with SQL against that SQL in DuckDB; the others must run."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from corvid.plans import context_catalog  # noqa: F401
from corvid.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SLOW = {"cmp02_campaigns", "cmp03_campaign_split"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.datetime)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert df.columns and (rows or name in SLOW)
        return
    told = duck.sql(ORACLES[name])
    assert sorted(told.columns) == sorted(df.columns)
    order = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    theirs = sorted((tuple(plain(r[told.columns.index(c)]) for c in order) for r in told.fetchall()), key=repr)
    assert mine == theirs
