"""Every registered query of the catalogue against its SQL, run by DuckDB on the same tables."""

import datetime as dt
import os

import duckdb
import pytest

from meterlight import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.mark.parametrize("name", catalog.queries())
def test_against_sql(spark, tables, name):
    found = catalog.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    got = sorted(tuple(map(plain, r)) for r in found.select(*columns).collect())
    result = tables.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_flagship(spark):
    assert catalog.flagship(spark, FOLDER).count() > 0
