"""Exact percentiles without gathering a group in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer,
which fails when one key holds a third of the rows. Here a first pass counts the
rows of narrow value buckets (combined before the shuffle), which tells in which
few buckets the wanted ranks lie; the next pass counts the distinct values of those
buckets only. A bucket too full for one task is cut into finer ones before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import log_bucket
from ..session import materialise
from .joins import join_null_safe

# Buckets per e-fold. Each is 1/4096 wide in relative terms: at 100 ms that is 24 us, so
# few distinct clock readings share one, yet counting combines most rows early.
BUCKETS_PER_E_FOLD = 4096

# Rows of one bucket that one task may put in order.
ROWS_PER_TASK = 5_000_000

# Parts into which a fuller bucket is cut.
PARTS = 4096


def bucket_of(value: str) -> Column:
    return log_bucket(f"CAST({value} AS DOUBLE)", BUCKETS_PER_E_FOLD)


def _rank(percent: float) -> str:
    """Fractional rank of a percentile among ``_n`` sorted values."""
    return f"(CAST(_n - 1 AS DOUBLE) * {percent / 100.0!r}D)"


def _bounds(percent: float) -> tuple[str, str]:
    low = f"floor({_rank(percent)})"
    return low, f"least({low} + 1, _n - 1)"


def _covers(rank: str, count: str) -> str:
    """Whether the rank falls among the ``count`` rows that follow ``_before`` rows."""
    return f"({rank} >= _before AND {rank} < _before + {count})"


def _spans_wanted(histogram: DataFrame, percents: Sequence[float]) -> DataFrame:
    """The buckets of a histogram with ``_before`` and ``_n`` that hold a wanted rank.

    They are a few per key; written out, their size is known to the planner.
    """
    wanted = " OR ".join(
        _covers(rank, "_count") for percent in percents for rank in _bounds(percent)
    )
    return materialise(histogram.where(wanted), "buckets")


def _rows_before(group: Sequence[str], order: str) -> Column:
    """Rows of the group that come before in the given order."""
    earlier = (
        Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.coalesce(F.sum("_count").over(earlier), F.lit(0))


def _counted() -> list[Column]:
    return [
        F.expr("sum(_weight) AS _count"),
        F.expr("min(_value) AS _low"),
        F.expr("max(_value) AS _high"),
    ]


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    percents: Sequence[float],
    names: Sequence[str],
    weight: str | None = None,
    histogram: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per key with the linearly interpolated percentiles of ``value``.

    The rank of percentile p among n sorted values is ``(n - 1) * p / 100``. NULL
    values do not count, and keys without a value are absent; NaN ranks above all other
    values. ``weight`` names a
    column saying how many rows each row stands for. Runs a job per pass; buckets
    that hold a single value need no second one.

    Whoever has counted the buckets already may hand in ``histogram``: the keys,
    ``_bucket`` by ``bucket_of``, ``_count``, and the extremes ``_low`` and ``_high``.
    """
    keys = list(keys)
    rows = (
        df.select(
            *keys,
            F.col(value).cast("double").alias("_value"),
            (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_weight"),
        )
        .where("_value IS NOT NULL")
        .withColumn("_bucket", bucket_of("_value"))
    )
    if histogram is None:
        histogram = rows.groupBy(*keys, "_bucket").agg(*_counted())
    ids = [*keys, "_bucket"]
    needed = _spans_wanted(
        histogram.select(
            *ids, "_count", "_low", "_high",
            _rows_before(keys, "_bucket").alias("_before"),
            F.sum("_count").over(Window.partitionBy(*keys)).alias("_n"),
        ),
        percents,
    )
    span = [*keys, "_n", "_before", "_value", "_count"]
    single = needed.where("_low = _high").withColumn("_value", F.col("_low"))
    settled = single.select(*span)
    needed = needed.where("_low < _high")
    fullest = needed.agg(F.max("_count")).first()[0]
    while fullest is not None and fullest > rows_per_task:
        part = f"_part{len(ids)}"
        parents = needed.select(
            *ids, "_before", "_n", F.col("_low").alias("_from"), F.col("_high").alias("_to")
        )
        rows = (
            join_null_safe(rows, parents, ids)
            .withColumn(part, F.expr(f"floor((_value - _from) / (_to - _from) * {PARTS}D)"))
        )
        counted = rows.groupBy(*ids, "_before", "_n", part).agg(*_counted())
        rows = rows.drop("_before", "_n", "_from", "_to")
        finer = counted.withColumn("_before", F.col("_before") + _rows_before(ids, part))
        ids = [*ids, part]
        needed = _spans_wanted(finer, percents)
        single = needed.where("_low = _high").withColumn("_value", F.col("_low"))
        settled = settled.unionByName(single.select(*span))
        needed = needed.where("_low < _high")
        before, fullest = fullest, needed.agg(F.max("_count")).first()[0]
        if fullest == before:
            break  # not split further; the last step orders it as it is
    if fullest is not None:
        values = (
            join_null_safe(rows, needed.select(*ids, "_before", "_n"), ids)
            .groupBy(*ids, "_n", "_before", "_value")
            .agg(F.sum("_weight").alias("_count"))
        )
        placed = values.withColumn("_before", F.col("_before") + _rows_before(ids, "_value"))
        settled = settled.unionByName(placed.select(*span))

    ends = settled.groupBy(*keys, "_n").agg(
        *[
            F.expr(f"max(CASE WHEN {_covers(rank, '_count')} THEN _value END) AS _{side}{i}")
            for i, percent in enumerate(percents)
            for side, rank in zip(("low", "high"), _bounds(percent), strict=True)
        ]
    )
    return ends.select(
        *keys,
        *[
            # Equal ends, or a rank that is whole, need no arithmetic that infinities break.
            F.expr(
                f"CASE WHEN _low{i} = _high{i} OR {_rank(percent)} = floor({_rank(percent)})"
                f" THEN _low{i} ELSE"
                f" _low{i} + (_high{i} - _low{i}) * ({_rank(percent)} - floor({_rank(percent)})) END"
            ).alias(name)
            for i, (percent, name) in enumerate(zip(percents, names, strict=True))
        ],
    )
