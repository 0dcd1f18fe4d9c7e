"""Queries of the text operators that SQL can express give the rows of DuckDB."""

import glob
import os

import duckdb
import pytest

from strataweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want, got = con.sql(ORACLES[name]), QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    names = sorted(got.columns)
    plain = lambda rows, at: sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=repr)
    assert plain(got.collect(), [got.columns.index(c) for c in names]) == plain(want.fetchall(), [want.columns.index(c) for c in names])
