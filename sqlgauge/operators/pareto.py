"""Configuration summaries: joining the reports, the Pareto front and rankings.

A summary row holds ``config``, ``execution_accuracy``, ``p50_ms``, ``p95_ms``,
``p99_ms``, ``req_per_sec``, ``tok_per_sec``, ``peak_gpu_mib`` and ``pareto``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import log_bucket
from .joins import join_null_safe
from .ordering import number_rows

# The columns of the summary table, in order.
SUMMARY_COLUMNS = (
    "config", "execution_accuracy", "p50_ms", "p95_ms", "p99_ms",
    "req_per_sec", "tok_per_sec", "peak_gpu_mib", "pareto",
)

_FRONT_BUCKETS_PER_E_FOLD = 16384


def join_reports(accuracy: DataFrame, latency: DataFrame) -> DataFrame:
    """One row per configuration that has an accuracy or a latency report."""
    speed = latency.select(
        "config",
        F.col("latency_ms.p50").alias("p50_ms"),
        F.col("latency_ms.p95").alias("p95_ms"),
        F.col("latency_ms.p99").alias("p99_ms"),
        F.col("throughput.requests_per_sec").alias("req_per_sec"),
        F.col("throughput.output_tokens_per_sec").alias("tok_per_sec"),
        F.col("peak_gpu_mem_mib").alias("peak_gpu_mib"),
    )
    return accuracy.select("config", "execution_accuracy").join(speed, "config", "full_outer")


def pareto_front(
    summary: DataFrame, accuracy: str = "execution_accuracy", latency: str = "p99_ms"
) -> DataFrame:
    """The (latency, accuracy) values that no other point dominates.

    A point is dominated by one at least as accurate and at least as fast that is
    strictly better in one of the two. NULL and 0 take no part.

    No pairs are formed: the best accuracy per latency is compared with the best of
    everything faster. That running maximum is taken over buckets of latency first,
    which drops most points, and inside each bucket by separate tasks afterwards.
    """
    x, y = F.col(latency), F.col(accuracy)
    best = (
        summary.where(x.isNotNull() & y.isNotNull() & (x != 0) & (y != 0))
        .groupBy(x.alias("_x"))
        .agg(F.max(y).alias("_y"))
        .withColumn("_bucket", log_bucket("CAST(_x AS DOUBLE)", _FRONT_BUCKETS_PER_E_FOLD))
    )
    faster = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        best.groupBy("_bucket")
        .agg(F.max("_y").alias("_peak"))
        .select("_bucket", F.max("_peak").over(faster).alias("_before"))
    )
    inside = (
        Window.partitionBy("_bucket").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        join_null_safe(best, earlier, ["_bucket"])
        .where(F.col("_before").isNull() | (F.col("_y") > F.col("_before")))
        .withColumn("_within", F.max("_y").over(inside))
        .where(F.col("_within").isNull() | (F.col("_y") > F.col("_within")))
        .select(F.col("_x").alias(latency), F.col("_y").alias(accuracy))
    )


def flag_pareto(
    summary: DataFrame, accuracy: str = "execution_accuracy", latency: str = "p99_ms"
) -> DataFrame:
    """Add ``pareto``. Points with equal values are on the front together."""
    front = pareto_front(summary, accuracy, latency).withColumn("_on_front", F.lit(True))
    flagged = summary.join(front, [latency, accuracy], "left")
    return flagged.select(
        *summary.columns, F.coalesce("_on_front", F.lit(False)).alias("pareto")
    )


def summary_table(summary: DataFrame) -> DataFrame:
    """Sorted by falling accuracy, a missing one as 0, then by name, with the place as
    ``rank`` from 0 (runs a job)."""
    order = [F.coalesce("execution_accuracy", F.lit(0.0)).desc(), F.col("config")]
    return number_rows(summary, order, name="rank").orderBy("rank")


def frontier(flagged: DataFrame) -> DataFrame:
    """The front by rising latency, with the place as ``rank`` from 0 (runs a job); empty
    when it has a single point."""
    front = flagged.where("pareto")
    points = front.agg(F.count("*")).scalar()
    ranked = number_rows(front.where(points > 1), ["p99_ms", "config"], name="rank")
    return ranked.orderBy("rank")


def baseline_delta(summary: DataFrame, baseline: str, max_loss_pp: float = 2.0) -> DataFrame:
    """Every configuration against a baseline: latency cut and throughput lift in
    percent, accuracy loss in percentage points and whether it is small enough."""
    reference = (
        summary.where(F.col("config") == baseline)
        .select(F.struct("p99_ms", "req_per_sec", "execution_accuracy"))
        .scalar()
    )
    p99 = reference.getField("p99_ms")
    req = reference.getField("req_per_sec")
    acc = reference.getField("execution_accuracy")
    loss = (acc - F.col("execution_accuracy")) * 100.0
    return summary.select(
        *summary.columns,
        (F.try_divide(p99 - F.col("p99_ms"), p99) * 100.0).alias("p99_cut_pct"),
        (F.try_divide(F.col("req_per_sec") - req, req) * 100.0).alias("throughput_lift_pct"),
        loss.alias("accuracy_loss_pp"),
        F.coalesce(loss < max_loss_pp, F.lit(False)).alias("within_loss"),
    )


def best_per_stack(delta: DataFrame, stack: str = "stack") -> DataFrame:
    """The fastest configuration of each stack among those within the accuracy loss.

    Lowest p99 wins, then higher accuracy, then the name.
    """
    key = F.struct(
        F.col("p99_ms"), (-F.col("execution_accuracy")).alias("_worse"), F.col("config")
    )
    eligible = delta.where(F.col("within_loss") & F.col("p99_ms").isNotNull())
    best = eligible.groupBy(stack).agg(F.min(key).alias("_best"))
    return best.select(
        stack,
        F.col("_best.config").alias("config"),
        F.col("_best.p99_ms").alias("p99_ms"),
        (-F.col("_best._worse")).alias("execution_accuracy"),
    )
