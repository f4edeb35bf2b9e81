"""Every registered query with a statement, against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry


def tables(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{t}'")
    return c


def norm(df):
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return repr(float(v) + 0.0) if isinstance(v, (int, float, np.number)) else str(v)

    return sorted("|".join(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_duckdb(spark, sf_dir, name):
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), tables(sf_dir).sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


@pytest.mark.parametrize("name", sorted(set(entry.core.QUERIES) - set(entry.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 16


def test_roads_of_nations_are_joined_once(spark, sf_dir):
    from causeway.sources import testdata

    assert testdata.edges(spark, sf_dir).inputFiles() == []  # written: reading it again reads no table
