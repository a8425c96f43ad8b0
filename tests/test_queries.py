"""Every registered query against its SQL twin, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float) and not math.isnan(value):
        return str(int(value)) if value == int(value) else repr(round(value, 6))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    columns, rows = df.columns, df.collect()
    if name in ORACLES:
        found = db.execute(ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(columns) == sorted(names)
        assert rows_of(columns, rows) == rows_of(names, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
