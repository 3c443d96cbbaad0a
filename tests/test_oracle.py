"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from strandline.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def same(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    want = db.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = sorted((tuple(same(r[c]) for c in want.columns) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(map(same, r)) for r in want.fetchall()), key=repr)


def test_without_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"xxh3_hashes"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 11
    assert set(e.oracle_sql()) <= set(e.queries())
