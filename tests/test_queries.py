"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import pytest

from matrixlake import queries as Q

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows(spark, con, name):
    df = Q.queries()[name](spark, SF)
    want = con.sql(Q.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    kinds = dict(df.dtypes)
    assert {c: KINDS[kinds[c]] for c in cols} == {c: str(t) for c, t in zip(want.columns, want.types, strict=True)}
    at = [want.columns.index(c) for c in cols]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=key)
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


def test_every_query_has_sql():
    assert set(Q.queries()) == set(Q.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as e

    if os.path.isdir(SF):
        assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
