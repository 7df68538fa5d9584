"""Every query with an oracle against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from factgraph.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    out = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        out.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return out


def test_names_agree():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, sf_dir, con, name):
    own = catalogue.queries()[name](spark, sf_dir)
    expected = con.sql(catalogue.oracle_sql()[name])
    assert sorted(own.columns) == sorted(expected.columns)
    columns = sorted(own.columns)
    rows = sorted(map(repr, map(tuple, own.select(*columns).collect())))
    assert rows == sorted(map(repr, expected.project(", ".join(f'"{c}"' for c in columns)).fetchall()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 7 and set(e.oracle_sql()) <= set(e.queries())
