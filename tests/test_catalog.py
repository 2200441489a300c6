"""Every registered query against its SQL counterpart on the smallest given tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry_point

DATA = "/root/testdata/sf0.001"

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def comparable(rows):
    def one(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds
    assert comparable(df.select(*columns).collect()) == comparable(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() == 20


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
