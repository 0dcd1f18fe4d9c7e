"""Each query with SQL gives the same rows as DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as registry

SF = "/root/testdata/sf0.001"
LLM = ("op", "pipeline")
NAMES = [n for n in registry.queries() if not n.startswith(LLM)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(float(v), 5) if type(v).__name__ == "Decimal" else v


def rows(names, values):
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in at) for r in values), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, duck):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = registry.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql)
        assert sorted(want.columns) == sorted(df.columns)
        assert got == rows(want.columns, want.fetchall())
    else:
        assert got


def test_entry(spark):
    assert registry.entry(spark).count() > 0
