"""The operators' queries that SQL can express, against it."""

from __future__ import annotations

import os

import duckdb
import pytest

from blockloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, small, name):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    df = queries.queries()[name](spark, small)
    told = con.sql(queries.oracle_sql()[name])
    order = [told.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in told.fetchall())
