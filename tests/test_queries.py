"""Every registered query against its DuckDB text, on the smallest sample."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return v
    if type(v).__name__ in ("bool", "bool_"):
        return bool(v)
    return int(v) if hasattr(v, "__index__") else str(v)


def _rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted((tuple(_cell(v) for v in r) for r in pdf.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    ours = driver.queries()[name](spark, SF_DIR).toPandas()
    theirs = duck.execute(driver.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)
    assert len(ours) > 0


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
