"""Every query of the library against its SQL on the smallest tables."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from pointloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def key(row):
    return tuple((v is None, "" if isinstance(v, (int, float)) else type(v).__name__, 0 if v is None else v) for v in row)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(spark, small, db, name):
    df = plans.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    told = db.sql(plans.SQL[name])
    assert sorted(told.columns) == cols
    at = [told.columns.index(c) for c in cols]
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in told.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL) - {"gbt_loo"}))
def test_has_rows(spark, small, name):
    assert plans.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
