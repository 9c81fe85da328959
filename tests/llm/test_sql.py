"""Queries that have SQL give DuckDB's rows."""

import os

import pytest

from matrixlake.llm import queries as Q

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(Q.oracle_sql()[name])
    df = Q.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def test_names():
    assert list(Q.queries()) == sorted(Q.queries(), key=lambda n: int(n[2:].split("_")[0])) and len(Q.queries()) == 10
