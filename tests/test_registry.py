"""Every registered query against its checking SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from conftest import SF
from sqlgauge.registry import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def checker():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield connection
    connection.close()


def sort_key(row):
    return [(cell is None, str(cell)) for cell in row]


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_sql(spark, checker, name):
    df = QUERIES[name](spark, SF)
    found = checker.execute(ORACLES[name])
    columns = sorted(column[0] for column in found.description)
    assert sorted(df.columns) == columns
    place = [[column[0] for column in found.description].index(c) for c in columns]
    expected = sorted((tuple(row[i] for i in place) for row in found.fetchall()), key=sort_key)
    got = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=sort_key)
    assert got == expected


def test_entry_points(spark):
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(QUERIES) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())
    verdicts = {r.id: r.status for r in entry_points.entry(spark).collect()}
    assert verdicts[0] == "match" and verdicts[7] == "gold_error"
