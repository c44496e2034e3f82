"""From raw examples and catalogs to prepared examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import build_messages
from ..operators.ordering import number_rows
from ..session import materialise
from ..sources.catalog import database_schemas, schema_texts


def database_path(root: str, db_id: Column, test: Column | bool = False) -> Column:
    """Where a database file lies below the root of the data set."""
    test = F.lit(test) if isinstance(test, bool) else test
    folder = F.when(test, F.lit("test_database")).otherwise(F.lit("database"))
    return F.concat_ws("/", F.lit(root), folder, db_id, F.concat(db_id, F.lit(".sqlite")))


def prepare_examples(
    raw: DataFrame, catalog: DataFrame, root: str = "", test: bool = False
) -> DataFrame:
    """Prepared examples of each split (runs jobs).

    ``raw`` is ``(split, file_no, pos, db_id, question, gold_sql)``. Examples whose
    database is missing or has no readable schema are dropped; the rest are numbered
    from 0 in file order, restarting per split.

    The catalog is read once: its schema texts are written to the shared folder, and
    their size there decides whether they are broadcast. The surviving examples are
    written too, since the sort reads its input twice and JSON is dear to parse; the
    texts are attached after it, so they are not sorted along.
    """
    schemas = materialise(schema_texts(catalog), "schemas")
    survivors = raw.join(schemas.select("db_id"), "db_id", "left_semi")
    survivors = materialise(survivors, "survivors")
    numbered = number_rows(survivors, ["file_no", "pos"], ["split"], "id")
    return numbered.join(schemas, "db_id").select(
        "split",
        "id",
        "db_id",
        database_path(root, F.col("db_id"), test).alias("db_path"),
        "question",
        "gold_sql",
        "schema",
        build_messages(F.col("schema"), F.col("question")).alias("messages"),
    )


def skipped_examples(raw: DataFrame, catalog: DataFrame) -> DataFrame:
    """The examples ``prepare_examples`` drops, with the reason."""
    known = database_schemas(catalog).select("db_id", F.col("schema").isNotNull().alias("_good"))
    reason = F.when(F.col("_good").isNull(), F.lit("missing database")).when(
        ~F.col("_good"), F.lit("bad schema")
    )
    return (
        raw.join(known, "db_id", "left")
        .withColumn("reason", reason)
        .where("reason IS NOT NULL")
        .drop("_good")
    )


def skip_counts(raw: DataFrame, catalog: DataFrame) -> DataFrame:
    """How many examples were dropped per split and reason."""
    return skipped_examples(raw, catalog).groupBy("split", "reason").agg(F.count("*").alias("n"))
