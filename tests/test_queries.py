"""Every query with SQL equals it on the smallest tables."""

import math
import os

import pytest

from evidentia.plans.catalogue import ORACLE, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}"
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(float(v), 6) + 0.0) if isinstance(v, int | float) else str(v)


def _canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cursor = con.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert _canon(df.columns, df.collect()) == _canon(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_every_query_has_a_name_of_its_own():
    assert set(ORACLE) <= set(QUERIES)
