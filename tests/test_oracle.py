"""Every query that has SQL gives the same columns, types and rows in DuckDB."""

import datetime
import math
import os

import duckdb
import pytest

from tablewright import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(row):
    return tuple(round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else repr(v) if isinstance(v, (list, dict)) else v for v in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, con, name):
    want = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(want.columns)
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KINDS[k] for c, k in df.dtypes if k in KINDS} == {c: types[c] for c, k in df.dtypes if k in KINDS}
    assert sorted(map(plain, df.select(*want.columns).collect()), key=repr) == sorted(map(plain, want.fetchall()), key=repr)


def test_each_query_has_sql_or_is_known_to_have_none():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) <= {"flagship"}
