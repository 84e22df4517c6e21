"""Every registered feature query against its SQL, on small tables with gapless hours."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from tidemark.queries.spark import QUERIES
from tidemark.queries.sql import SQL

DATA = os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("events", "lineitem", "orders", "customer"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return repr(float(v)) if isinstance(v, (int, float, np.number)) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"ffm_epoch", "source_fit_losses", "fitted_predictions"}))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_loss_falls_over_epochs(spark):
    losses = [r["logloss"] for r in QUERIES["ffm_epoch"](spark, DATA).orderBy("epoch").collect()]
    assert losses[0] > losses[1] > losses[2]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1000
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql())
