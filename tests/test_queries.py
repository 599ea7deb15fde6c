"""Every query with a SQL twin gives the twin's rows at the smallest scale."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tracemill.plans.catalog import SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    frame = queries()[name](spark, FOLDER)
    cursor = duck.execute(oracle_sql()[name])
    assert normal(frame.columns, frame.collect()) == normal([c[0] for c in cursor.description], cursor.fetchall())


def test_every_query_has_a_twin():
    from tracemill.plans.catalog import BUILDS

    assert set(BUILDS) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() == 1
