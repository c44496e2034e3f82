"""The registered queries on the smallest tables, and the pipeline stage by stage."""

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from conftest import SF
from sqlgauge.llm.queries import ORACLES, QUERIES
from sqlgauge.session import materialise


@pytest.fixture(scope="module")
def checker():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield connection
    connection.close()


def test_all_are_registered():
    names = entry_points.queries()
    for number in range(1, 14):
        assert sum(name.startswith(f"op{number}_") for name in names) == 1
    assert "pipeline" in names and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ORACLES)
def test_query_agrees_with_sql(spark, checker, name):
    df = QUERIES[name](spark, SF)
    found = checker.execute(ORACLES[name])
    columns = [column[0] for column in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(found.fetchall())


def test_pipeline(spark):
    docs = given = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in given.collect()}
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF))
        counts.append(docs.count())
        if name != "token files":
            assert sorted(docs.columns) == sorted(given.columns)
            assert all(texts[r.doc_id] == r.text for r in docs.collect())
    assert given.count() >= counts[0] >= counts[1] >= counts[2] > 0
    assert counts[3] == counts[4]
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_pipeline_on_odd_rows(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF))
    assert docs.count() <= 4
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = materialise(stage(spark, empty, SF))
    assert empty.count() == 0
