"""Every query that has a twin in SQL is held against DuckDB; the others have to run and give stable columns."""

import math

import pandas as pd
import pytest

from recallgrid.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):  # whole numbers beside missing ones are floats in pandas
        v = round(float(v), 6)
        return str(int(v)) if v.is_integer() else repr(v)
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, data, name):
    assert rows(QUERIES[name](spark, data).toPandas()) == rows(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    out = QUERIES[name](spark, data)
    assert out.columns and out.count() >= 0


def test_entry(spark):
    from recallgrid.plans.search import entry

    out = entry(spark, "/root/testdata/sf0.001")
    assert out.columns == ["id", "score", "bm25", "cos"] and 0 < out.count() <= 10
