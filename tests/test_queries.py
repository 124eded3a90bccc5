"""Each query against its SQL twin, on whole tables."""

import glob
import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as driver
from gradeloom import queries as Q

DATA = "/root/testdata/sf0.001"


def rows(df):
    def plain(x):
        if pd.isna(x):
            return None
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        return round(float(x), 6) if isinstance(x, (int, float, np.number)) else x

    df = df[sorted(df.columns)]
    return sorted([[str(plain(x)) for x in r] for r in df.itertuples(index=False)])


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_twin(spark, duck, name):
    a, b = driver.queries()[name](spark, DATA).toPandas(), duck.sql(Q.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_keys():
    assert set(driver.oracle_sql()) <= set(driver.queries())
