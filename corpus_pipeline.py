"""The corpus pipeline: from raw documents to token-id files, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it lets through, in the
columns of ``documents``; the last one returns the places of the documents in the files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sqlgauge.llm.common import table
from sqlgauge.llm.contamination import drop_contaminated
from sqlgauge.llm.minhash import drop_near_duplicates
from sqlgauge.llm.mixing import mixed
from sqlgauge.llm.token_files import token_digests, write_token_files
from sqlgauge.llm.toxicity import drop_toxic
from sqlgauge.session import materialise, ship_package

VOCABULARY = "byte_bpe_50k.json"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trained field does not find toxic."""
    ship_package(spark)
    return drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_package(spark)
    return drop_near_duplicates(docs.select(*COLUMNS))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or edited."""
    ship_package(spark)
    return drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def to_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    ship_package(spark)
    return mixed(docs.select(*COLUMNS))


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of all documents; their places and checksums, read back from them."""
    import public_tokenizers

    ship_package(spark)
    return token_digests(write_token_files(docs, public_tokenizers.path(VOCABULARY)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near duplicates", without_near_copies),
    ("decontamination", without_leaks),
    ("mixing", to_mix),
    ("token files", to_token_files),
]

# A trained model, sampling and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next one starts."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
