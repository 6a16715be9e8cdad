"""The entry point: every query over logs against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as e
from quern.plans import registry


def test_entry(spark, small):
    assert e.entry(spark).count() > 0


def test_names():
    assert set(registry.SQL) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def same(v):
    return float(f"{v:.10g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_gives_what_its_sql_gives(spark, small, name):
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(small):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    df, rel = e.queries()[name](spark, small), db.sql(e.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(same(r[i]) for i in at) for r in rel.fetchall()), key=repr)
