"""Database catalogs: which tables a database has and their CREATE statements.

A catalog is ``(db_id, type, table_name, ddl)``, one row per schema object. A
database whose file is empty or unreadable is one row with nothing but its ``db_id``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_ddl, decode_utf8
from ..operators.sampling import require_rows

CATALOG_TYPE = "db_id string, type string, table_name string, ddl string"


def read_catalog(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Catalog from dumps of schema tables as JSON lines, in files of any size.

    A line is a schema object (``type``, ``table_name``, ``ddl``) and may name its database
    as ``db_id``, so that one file holds many. Otherwise the database is named after the
    file, or the folder, without its extension. Bytes that are no UTF-8 are dropped. Lines
    that do not parse are rows with nothing but their ``db_id``, as is fit for a database
    that cannot be read; blank lines are skipped.
    """
    lines = spark.read.text(paths).select(
        decode_utf8(F.col("value").cast("binary")).alias("line"),
        F.col("_metadata.file_path").alias("place"),
    )
    named = F.regexp_extract("place", r"/([^/]+?)(?:\.[^./]*)?(?:/part-[^/]*)?$", 1)
    objects = lines.where(F.btrim("line", F.lit(" \t\r\n")) != "").select(
        "place", F.from_json("line", CATALOG_TYPE).alias("o")
    )
    return objects.select(
        F.coalesce("o.db_id", F.url_decode(named)).alias("db_id"),
        "o.type",
        "o.table_name",
        "o.ddl",
    )


def is_user_table() -> Column:
    """Whether a catalog row is a table with a CREATE statement that is not internal.

    The underscore of the name test is a wildcard: every name that starts with
    'sqlite', in any case, and has at least one more character counts as internal.
    """
    return F.expr("type = 'table' AND ddl IS NOT NULL AND NOT lower(table_name) LIKE 'sqlite_%'")


def database_schemas(catalog: DataFrame) -> DataFrame:
    """One row per database: its CREATE statements in table name order as one text,
    NULL where there is none.

    The text is a single value by definition, so the statements of one database, and
    no more than those, meet in one task.
    """
    statement = F.struct("table_name", clean_ddl(F.col("ddl")).alias("ddl"))
    joined = F.array_join(F.transform("_tables", lambda t: t["ddl"]), ";\n\n")
    return (
        catalog.groupBy("db_id")
        .agg(F.sort_array(F.collect_list(F.when(is_user_table(), statement))).alias("_tables"))
        .select(
            "db_id",
            F.when(F.size("_tables") > 0, F.concat(joined, F.lit(";"))).alias("schema"),
        )
    )


def schema_texts(catalog: DataFrame) -> DataFrame:
    """The schema texts of the databases that have one.

    What is no user table is left out before the shuffle.
    """
    return database_schemas(catalog.where(is_user_table())).where("schema IS NOT NULL")


def schema_text(catalog: DataFrame, db_id: str) -> DataFrame:
    """The schema text of one database; ValueError when it has no user table."""
    return require_rows(
        schema_texts(catalog.where(F.col("db_id") == db_id)), f"tables in {db_id}"
    )
