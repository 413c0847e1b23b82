"""Every registered query against its SQL counterpart in a second engine."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

DIRECTORY = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{DIRECTORY}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def ordered(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 100


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    frame = contract.queries()[name](spark, DIRECTORY)
    columns = sorted(frame.columns)
    rows = ordered(tuple(plain(value) for value in row) for row in frame.select(*columns).collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [entry[0] for entry in result.description]
    assert sorted(names) == columns
    types = {entry[0]: str(entry[1]) for entry in result.description}
    assert {column: TYPES.get(kind, kind) for column, kind in frame.dtypes} == types
    places = [names.index(column) for column in columns]
    assert rows == ordered(tuple(plain(row[place]) for place in places) for row in result.fetchall())
