"""Dense row numbers and running maxima that no single task has to compute alone.

A window over a whole table, or over one hot key, sorts all its rows in one task.
Here the rows are sorted once across the cluster, kept in the shared folder with
the partition each row fell into, and only one small row per (key, partition) is
put in sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .joins import join_null_safe

# monotonically_increasing_id() keeps the partition number above these bits.
_PARTITION_SHIFT = 33


def in_sequence(df: DataFrame) -> DataFrame:
    """Add ``_seq``, which grows in the present row order. Gaps are allowed."""
    return df.withColumn("_seq", F.monotonically_increasing_id())


def dense_numbers(placed: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Turn the stored ``_seq`` into 0, 1, 2, ... per key.

    Within one partition the rows of a key must be contiguous in ``_seq``, which a
    sort by the keys first guarantees. The table of offsets holds at most one row per
    key and partition; it is written out so that the planner knows its size and, when
    it is small, leaves the numbered rows where they are (runs a job).
    """
    keys = list(keys)
    placed = placed.withColumn("_part", F.shiftright("_seq", _PARTITION_SHIFT))
    pieces = placed.groupBy(*keys, "_part").agg(
        F.count("*").alias("_size"), F.min("_seq").alias("_first")
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offset = F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first")
    starts = materialise(pieces.select(*keys, "_part", offset.alias("_offset")), "offsets")
    numbered = join_null_safe(placed, starts, [*keys, "_part"])
    return numbered.withColumn(name, F.col("_seq") + F.col("_offset")).drop(
        "_seq", "_part", "_offset"
    )


def number_rows(
    df: DataFrame,
    order_by: Sequence[str | Column] | None,
    partition_by: Sequence[str] = (),
    name: str = "row_no",
) -> DataFrame:
    """Dense 0-based row numbers, restarting per ``partition_by`` (runs a job).

    ``order_by=None`` keeps the order the DataFrame already has. An order with
    ties is settled once, when the sorted rows are written. Sorting reads its input
    twice, the first time to find even ranges, so hand in what is cheap to read.
    """
    if order_by is not None:
        df = df.orderBy(*partition_by, *order_by)
    elif partition_by:
        raise ValueError("numbering per key needs an order")
    return dense_numbers(materialise(in_sequence(df), "rows"), partition_by, name)


def batch_numbers(
    df: DataFrame, order_by: Sequence[str | Column], batch_size: int, name: str = "batch_id"
) -> DataFrame:
    """Fixed-size batches in the given order: 0 for the first ``batch_size`` rows."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    numbered = number_rows(df, order_by, name="_row")
    return numbered.withColumn(name, F.floor(F.col("_row") / batch_size)).drop("_row")


def running_max(
    df: DataFrame, keys: Sequence[str], order: str, value: str, chunk: Column, name: str
) -> DataFrame:
    """Running maximum per key over rows that are unique in (keys, order).

    ``chunk`` cuts the order axis into stretches of limited size (an hour, say) and
    must not decrease along it. Each stretch is scanned by its own task; the maxima
    of the stretches before it are added from a table of one row per stretch.
    """
    keys = list(keys)
    rows = df.withColumn("_chunk", chunk)
    before = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.max(value).alias("_peak"))
        .select(*keys, "_chunk", F.max("_peak").over(before).alias("_before"))
    )
    within = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = join_null_safe(rows, earlier, [*keys, "_chunk"])
    peak = F.greatest(F.col("_before"), F.max(value).over(within))
    return joined.withColumn(name, peak).drop("_chunk", "_before")
