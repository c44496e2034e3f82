"""Verdict texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def status_family(status: Column) -> Column:
    """The part of a status before its first colon."""
    return F.substring_index(status, ":", 1)


def order_matters(gold_sql: Column) -> Column:
    """Whether the gold query mentions ``order by`` anywhere, in any case."""
    return F.contains(F.lower(gold_sql), F.lit("order by"))


def verdict_status(
    gold_outcome: Column,
    gold_message: Column,
    pred_sql: Column,
    pred_outcome: Column,
    pred_message: Column,
    results_equal: Column,
) -> Column:
    """One status per example. A failing gold query comes first, then a blank
    prediction, then the prediction's own failures, then the comparison."""
    return (
        F.when(
            gold_outcome != "ok",
            F.concat(F.lit("gold_error: "), F.coalesce(gold_message, F.lit(""))),
        )
        .when(strip(F.coalesce(pred_sql, F.lit(""))) == "", F.lit("pred_error: empty"))
        .when(pred_outcome == "timeout", F.lit("pred_timeout"))
        .when(
            pred_outcome != "ok",
            F.concat(F.lit("pred_error: "), F.coalesce(pred_message, F.lit(""))),
        )
        .when(results_equal, F.lit("match"))
        .otherwise(F.lit("mismatch"))
    )
