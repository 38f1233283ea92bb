"""Each query of the library against its SQL in DuckDB, and the row counts of those without."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from takewise.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 7) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    asked = duck.execute(SQL[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == sorted(got.columns)
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(plain(r[i]) for i in order) for r in asked.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
