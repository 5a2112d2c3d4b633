"""Every registered query against its SQL counterpart, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as registered

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def _rows(columns, names, rows):
    order = [names.index(c) for c in columns]
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, sql, name):
    frame = registered.queries()[name](spark, FOLDER)
    rows = frame.collect()
    assert rows
    if name not in registered.oracle_sql():
        return
    cursor = sql.execute(registered.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    columns = sorted(frame.columns)
    assert _rows(columns, frame.columns, rows) == _rows(columns, names, cursor.fetchall())


def test_entry(spark):
    assert registered.entry(spark).count() == 4
    assert set(registered.oracle_sql()) <= set(registered.queries())
