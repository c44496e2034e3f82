"""Equality of query results, for two DataFrames or for any number of pairs at once.

The long form of results is ``(example_id, side, row_no, cells)``: one row per
result row, ``side`` being 'gold' or 'pred', ``cells`` the canonical texts and
``row_no`` the position, NULL where order does not count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_row, positional
from .ordering import number_rows

RESULTS_TYPE = "example_id bigint, side string, row_no bigint, cells array<string>"


def long_form(
    rows: DataFrame,
    example_id: Column,
    side: str,
    cells: Column,
    row_no: Column | None = None,
) -> DataFrame:
    """Result rows in long form."""
    position = F.lit(None) if row_no is None else row_no
    return rows.select(
        example_id.alias("example_id"),
        F.lit(side).alias("side"),
        position.cast("bigint").alias("row_no"),
        cells.alias("cells"),
    )


def long_form_pairs(
    rows: DataFrame,
    example_id: Column,
    gold_cells: Column,
    pred_cells: Column,
    gold_no: Column | None = None,
    pred_no: Column | None = None,
) -> DataFrame:
    """Both sides in long form where each row carries a gold and a predicted row.

    Whatever lies before is scanned and joined once instead of once per side.
    """
    sides = [
        F.struct(
            F.lit(side).alias("side"),
            (F.lit(None) if number is None else number).cast("bigint").alias("row_no"),
            cells.alias("cells"),
        )
        for side, cells, number in (("gold", gold_cells, gold_no), ("pred", pred_cells, pred_no))
    ]
    return rows.select(example_id.alias("example_id"), F.inline(F.array(*sides)))


def row_balance(results: DataFrame, id_columns: Sequence[str] = ("example_id",)) -> DataFrame:
    """How often each distinct row occurs on either side.

    Grouping includes the cells, so the rows of one huge result spread over the
    cluster, and repeated rows are combined before the shuffle.
    """
    return results.groupBy(*id_columns, "row_no", "cells").agg(
        F.count_if(F.col("side") == "gold").alias("gold_count"),
        F.count_if(F.col("side") == "pred").alias("pred_count"),
    )


def compare_results(results: DataFrame, id_columns: Sequence[str] = ("example_id",)) -> DataFrame:
    """One row per example that has any result row: equality and both sizes.

    As multisets where ``row_no`` is NULL, position by position elsewhere. An
    example with two empty results is absent here and counts as equal.
    """
    return (
        row_balance(results, id_columns)
        .groupBy(*id_columns)
        .agg(
            F.bool_and(F.col("gold_count") == F.col("pred_count")).alias("results_equal"),
            F.sum("gold_count").alias("gold_rows"),
            F.sum("pred_count").alias("pred_rows"),
        )
    )


def mismatch_rows(results: DataFrame, id_columns: Sequence[str] = ("example_id",)) -> DataFrame:
    """The rows found more often on one side than on the other."""
    return row_balance(results, id_columns).where(F.col("gold_count") != F.col("pred_count"))


def pair_results(
    gold: DataFrame, pred: DataFrame, order_matters: bool, digits: int | None = None
) -> DataFrame:
    """Two results in long form, under example 0.

    With ``order_matters`` both sides are numbered in the order they have, which
    runs a job for each.
    """
    sides = []
    for side, df in (("gold", gold), ("pred", pred)):
        df = positional(df)
        rows = df.select(canonical_row(df, digits).alias("cells"))
        row_no = None
        if order_matters:
            rows = number_rows(rows, None)
            row_no = F.col("row_no")
        sides.append(long_form(rows, F.lit(0).cast("bigint"), side, F.col("cells"), row_no))
    return sides[0].unionByName(sides[1])


def results_match(
    gold: DataFrame, pred: DataFrame, order_matters: bool, digits: int | None = None
) -> DataFrame:
    """A single row ``(results_equal, gold_rows, pred_rows)`` for two results."""
    balance = row_balance(pair_results(gold, pred, order_matters, digits), ())
    return balance.agg(
        F.coalesce(
            F.bool_and(F.col("gold_count") == F.col("pred_count")), F.lit(True)
        ).alias("results_equal"),
        F.coalesce(F.sum("gold_count"), F.lit(0)).alias("gold_rows"),
        F.coalesce(F.sum("pred_count"), F.lit(0)).alias("pred_rows"),
    )
