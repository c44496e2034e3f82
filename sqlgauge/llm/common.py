"""Small pieces the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` only, so that no other column's name can clash."""
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    )


def text_key(text: Column) -> Column:
    """With the id this names a row; rows equal in both are one document given twice."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def task_count(spark: SparkSession, total: float, per_task: float) -> int:
    """Tasks for ``total`` units, never below the session's shuffle partitions."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, int(total // per_task) + 1)


MATCH_COLUMNS = ["_null", "_id", "_key"]


def match_columns(id_column: str, key: Column) -> list[Column]:
    """Three columns without nulls that name a row, for plain equality joins."""
    number = F.col(id_column).cast("long")
    return [
        number.isNull().alias("_null"),
        F.coalesce(number, F.lit(0)).alias("_id"),
        key.alias("_key"),
    ]


def with_match(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows as one struct ``_row``, safe from other names, beside the match columns."""
    return docs.select(
        F.struct("*").alias("_row"), *match_columns(id_column, text_key(F.col(text_column)))
    )
