"""Every query of the library with SQL, against DuckDB on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from plumbline import plans

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, db, name):
    found = plans.QUERIES[name](spark, SMALL)
    other = db.sql(plans.SQL[name])
    assert sorted(found.columns) == sorted(other.columns)
    ours, theirs = rows(found.columns, found.collect()), rows(other.columns, other.fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert a == b or [type(x) for x in a if isinstance(x, float)] and a == pytest.approx(b, rel=1e-9), (a, b)


def test_queries_without_sql(spark):
    for name in plans.QUERIES.keys() - plans.SQL.keys():
        assert plans.QUERIES[name](spark, SMALL).count() > 0
