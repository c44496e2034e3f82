"""Reading raw splits (JSON arrays) and prepared examples (JSON lines)."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import MESSAGES_TYPE
from ..operators.sampling import head_limit, require_rows
from .arrays import read_array_objects

log = logging.getLogger(__name__)

PREPARED_TYPE = (
    "id bigint, db_id string, db_path string, question string, gold_sql string, "
    f"schema string, messages {MESSAGES_TYPE}"
)
# ``query`` and ``SQL`` are variants because a key set to null differs from a missing key.
RAW_TYPE = "db_id string, question string, query variant, SQL variant"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    return hadoop_path.getFileSystem(configuration).exists(hadoop_path)


def gold_text(query, sql):
    """The gold query: ``query`` if that key exists, even as null, else ``SQL``, else ''."""
    return F.when(query.isNotNull(), F.variant_get(query, "$", "string")).otherwise(
        F.when(sql.isNotNull(), F.variant_get(sql, "$", "string")).otherwise(F.lit(""))
    )


def read_raw_split(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The examples of JSON array files as ``file_no, pos, db_id, question, gold_sql``.

    Files count in the order listed; a missing one is warned about and left out.
    ``pos`` grows within a file but has gaps. Every file is read by many tasks, however
    few records a line or the file as a whole has (runs jobs). What is no array of objects
    with fields of these types fails the read.
    """
    parts = []
    objects: dict[str, DataFrame] = {}
    for number, path in enumerate(paths):
        if path not in objects:
            if not path_exists(spark, path):
                log.warning("missing %s, skipping", path)
                continue
            objects[path] = read_array_objects(spark, path)
        parts.append(
            objects[path]
            .select("pos", F.from_json("value", RAW_TYPE, {"mode": "FAILFAST"}).alias("r"))
            .select(
                F.lit(number).alias("file_no"),
                "pos",
                "r.db_id",
                "r.question",
                gold_text(F.col("r.query"), F.col("r.SQL")).alias("gold_sql"),
            )
        )
    if not parts:
        empty = "file_no int, pos bigint, db_id string, question string, gold_sql string"
        return spark.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, parts)


def read_examples(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str = PREPARED_TYPE,
    limit: int | None = None,
    allow_empty: bool = True,
) -> DataFrame:
    """Prepared examples from JSON lines with declared types; blank lines are skipped.

    ``limit`` keeps the first rows in file order (0 or None: all); files after the one in
    which it is reached are not read. A malformed line fails the read.
    ``allow_empty=False`` raises ValueError when nothing is left.
    """
    paths = [path] if isinstance(path, str) else list(path)

    def lines(files: Sequence[str]) -> DataFrame:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(list(files))

    rows = lines(paths)
    if not allow_empty:
        require_rows(rows, "examples")
    if not limit:
        return rows
    files = sorted(rows.inputFiles())
    taken = 1
    while taken < len(files) and lines(files[:taken]).limit(limit).count() < limit:
        taken *= 2
    if not files:
        return rows
    placed = lines(files[:taken]).select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return head_limit(placed, ["_file", "_block", "_line"], limit).drop("_file", "_block", "_line")
