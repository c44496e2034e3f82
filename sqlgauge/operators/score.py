"""From outcomes and comparisons to verdicts, accuracy and status counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rate, round_half_even
from ..functions.status import status_family, verdict_status
from .compare import compare_results

OUTCOMES_TYPE = "example_id bigint, side string, outcome string, message string"


def outcomes_by_example(outcomes: DataFrame) -> DataFrame:
    """Outcomes of both sides on one row per example.

    ``outcomes`` is ``(example_id, side, outcome, message)`` with the outcome being
    'ok', 'error' or 'timeout', one row per executed query.
    """
    sides = [
        F.max(F.when(F.col("side") == side, F.col(column))).alias(f"{side}_{column}")
        for side in ("gold", "pred")
        for column in ("outcome", "message")
    ]
    return outcomes.groupBy("example_id").agg(*sides)


def _outcome(side: str) -> tuple[Column, Column]:
    """Outcome and message of one side; a missing outcome is an error."""
    outcome, message = F.col(f"{side}_outcome"), F.col(f"{side}_message")
    return (
        F.coalesce(outcome, F.lit("error")),
        F.when(outcome.isNull(), F.lit("not executed")).otherwise(message),
    )


def score_examples(
    examples: DataFrame, results: DataFrame, outcomes: DataFrame, id_column: str = "id"
) -> DataFrame:
    """Add ``correct``, ``status`` and both result sizes to every example.

    ``examples`` needs ``pred_sql``. A query without an outcome was not executed, which is
    an error of its side, never a match. Examples, outcomes and comparisons all have one
    row per example when they meet, so no key is hot in these joins.
    """
    verdicts = compare_results(results)
    judged = (
        examples.join(
            outcomes_by_example(outcomes).withColumnRenamed("example_id", id_column),
            id_column,
            "left",
        )
        .join(verdicts.withColumnRenamed("example_id", id_column), id_column, "left")
        .withColumn(
            "status",
            verdict_status(
                *_outcome("gold"),
                F.col("pred_sql"),
                *_outcome("pred"),
                F.coalesce("results_equal", F.lit(True)),
            ),
        )
    )
    return judged.select(
        *[F.col(c) for c in examples.columns],
        (F.col("status") == "match").alias("correct"),
        "status",
        F.coalesce("gold_rows", F.lit(0)).alias("gold_rows"),
        F.coalesce("pred_rows", F.lit(0)).alias("pred_rows"),
    )


def execution_accuracy(
    verdicts: DataFrame, keys: Sequence[str] = (), gen_seconds: Column | None = None
) -> DataFrame:
    """Accuracy to four digits per configuration. Gold errors stay in the count.

    Without keys there is always one row, with accuracy 0.0 for no examples.
    ``gen_seconds``, constant per configuration, adds the generation speed.
    """
    correct = F.coalesce(F.sum(F.col("correct").cast("bigint")), F.lit(0))
    extra = [] if gen_seconds is None else [F.max(gen_seconds).cast("double").alias("_seconds")]
    totals = verdicts.groupBy(*keys).agg(F.count("*").alias("n"), correct.alias("correct"), *extra)
    if gen_seconds is None:
        return _rates(totals.withColumn("_seconds", F.lit(None))).drop(
            "gen_seconds", "examples_per_sec"
        )
    return _rates(totals)


def _rates(totals: DataFrame) -> DataFrame:
    """Rounded accuracy and generation speed from ``n``, ``correct`` and ``_seconds``."""
    return (
        totals.withColumn("_share", F.coalesce(rate("correct", "n"), F.lit(0.0)))
        .withColumn("_speed", rate("n", "_seconds"))
        .withColumns(
            {
                "execution_accuracy": round_half_even("_share", 4),
                "examples_per_sec": round_half_even("_speed", 3),
                "gen_seconds": round_half_even("_seconds", 2),
            }
        )
        .drop("_share", "_speed", "_seconds")
    )


def status_counts(verdicts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many examples fall into each status family."""
    family = status_family(F.col("status")).alias("status")
    return verdicts.groupBy(*keys, family).agg(F.count("*").alias("n"))


def metrics(
    verdicts: DataFrame, keys: Sequence[str], gen_seconds: Column | None = None
) -> DataFrame:
    """Accuracy report with the status histogram as a map, one row per configuration.

    Verdicts are counted once, by status family; the report adds those counts up.
    """
    seconds = F.lit(None) if gen_seconds is None else gen_seconds
    counted = verdicts.groupBy(*keys, status_family(F.col("status")).alias("status")).agg(
        F.count("*").alias("n"),
        F.count_if("correct").alias("correct"),
        F.max(seconds.cast("double")).alias("_seconds"),
    )
    totals = counted.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("_n"),
        F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"),
        F.max("_seconds").alias("_seconds"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias(
            "status_counts"
        ),
    ).withColumnRenamed("_n", "n")
    report = _rates(totals)
    return report if gen_seconds is not None else report.drop("gen_seconds", "examples_per_sec")
