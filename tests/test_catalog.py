"""Every registered query against its SQL twin in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from blockloom.plans import catalog

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("NULL" if r[i] is None else f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, small, name):
    df = catalog.queries()[name](spark, small)
    told = duck.sql(catalog.oracle_sql()[name])
    kinds = dict(zip(told.columns, map(str, told.types), strict=True))
    assert {c: SPARK_TO_DUCK[k] for c, k in df.dtypes} == kinds
    assert rows(df.columns, df.collect()) == rows(told.columns, told.fetchall())


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
