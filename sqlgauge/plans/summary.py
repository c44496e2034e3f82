"""From reports to the flagged summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.pareto import SUMMARY_COLUMNS, flag_pareto
from ..session import materialise
from ..sources.reports import read_results_tree, write_summary


def summarise(reports: DataFrame) -> DataFrame:
    """Joined reports with the Pareto flag, in the fixed column order (runs jobs).

    The reports are kept in the shared folder before and after flagging: they are one
    row per configuration, and whatever is asked of the summary next must not read
    the logs behind them again.
    """
    kept = materialise(reports, "reports")
    return materialise(flag_pareto(kept).select(*SUMMARY_COLUMNS), "summary")


def summarise_tree(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Read a results tree, flag the front and write the summary as CSV."""
    table = summarise(read_results_tree(spark, root))
    write_summary(table, out)
    return table
