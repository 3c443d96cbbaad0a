"""The registered queries: SQL where DuckDB can say it, and all by name."""

import os

import duckdb
import pytest

from strandline.llm import common, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def same(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, db, name):
    df = queries.queries()[name](spark, SF)
    want = db.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = sorted((tuple(same(r[c]) for c in want.columns) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(map(same, r)) for r in want.fetchall()), key=repr)


def test_every_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op"))
    assert numbers == list(range(1, 11))


def test_small_tables_are_dealt_to_all_cores(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan(common.texts(spark, SF, "documents"))
    monkeypatch.setattr(common, "SMALL_TABLE", 1)
    assert "Repartition" not in plan(common.texts(spark, SF, "documents"))
