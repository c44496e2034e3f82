"""Report files: writing examples, predictions, metrics and summaries; reading a results tree."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.pareto import SUMMARY_COLUMNS, join_reports
from ..operators.sampling import require_rows
from .tree import read_tree, write_results_tree

__all__ = [
    "LATENCY_TYPE", "METRICS_TYPE", "read_reports", "read_results_tree", "write_json_lines",
    "write_reports", "write_results_tree", "write_summary",
]

METRICS_TYPE = (
    "model string, adapter string, backend string, n bigint, execution_accuracy double, "
    "correct bigint, status_counts map<string,bigint>, gen_seconds double, "
    "examples_per_sec double"
)
LATENCY_TYPE = (
    "model string, base_url string, concurrency int, num_requests bigint, failed bigint, "
    "wall_seconds double, latency_ms struct<mean:double,p50:double,p95:double,p99:double,"
    "max:double>, throughput struct<requests_per_sec:double,output_tokens_per_sec:double>, "
    "output_tokens_total bigint, peak_gpu_mem_mib bigint, max_new_tokens int"
)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines in UTF-8, keeping keys whose value is NULL."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_reports(
    reports: DataFrame, path: str, mode: str = "errorifexists", folder_per_config: bool = False
) -> None:
    """Reports as JSON lines, if wanted in one folder per configuration under ``path``.

    The folders suit people comparing a few configurations; with many they would be
    many tiny files.
    """
    writer = reports.write.mode(mode).option("ignoreNullFields", False)
    if folder_per_config:
        writer = writer.partitionBy("config")
    writer.json(path)


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reports written by ``write_reports``, with their configuration."""
    return spark.read.schema(f"{schema}, config string").json(path)


def write_summary(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The summary as CSV with fixed columns, by configuration; absent values stay empty.

    A ``rank`` column, where there is one, is written as well and gives the order.
    """
    extra = ["rank"] if "rank" in summary.columns else []
    ordered = summary.select(*SUMMARY_COLUMNS, *extra).orderBy("config")
    ordered.write.mode(mode).option("header", True).csv(path)


def read_results_tree(spark: SparkSession, root: str) -> DataFrame:
    """Summary rows of a tree ``root/<config>/metrics.json`` and ``latency.json``, as
    ``write_results_tree`` writes it, or of the folders that Spark writes in its place.

    A configuration may lack one of the files. Finding none at all is a ValueError.
    """
    schemas = {"metrics.json": METRICS_TYPE, "latency.json": LATENCY_TYPE}
    try:
        found = read_tree(spark, root, schemas)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"no metrics under {root} found") from error
    return require_rows(
        join_reports(found["metrics.json"], found["latency.json"]), f"metrics under {root}"
    )
