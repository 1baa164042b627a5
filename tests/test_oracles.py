"""Every query against SQL on the same tables, in DuckDB."""

import math
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tickloom.plans.oracles import ORACLES
from tickloom.plans.queries import comparable_queries

QUERIES = comparable_queries()


@pytest.fixture(scope="module")
def database(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            connection.execute(f"create view {name[:-8]} as select * from '{sf_dir}/{name}'")
    return connection


def plain(value):
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat() + "T00:00:00"
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def ordered(rows):
    return sorted((tuple(map(plain, row)) for row in rows), key=lambda row: [(v is None, str(v)) for v in row])


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, database, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = ordered(frame.select(*[f"`{column}`" for column in columns]).collect())
    assert got
    result = database.execute(ORACLES[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == columns
    places = [names.index(column) for column in columns]
    wanted = ordered([tuple(row[place] for place in places) for row in result.fetchall()])
    assert got == wanted


def test_entry(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
