"""Latency and throughput reports over request logs, and peak memory over samples.

A request log has one row per request: the configuration, ``ok``, ``latency_ms``,
``out_tokens``, ``start_ts`` and ``end_ts``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rate, round_half_even
from ..functions.prompts import messages_or_default
from ..session import materialise
from .joins import join_null_safe
from .ordering import number_rows, running_max
from .percentiles import bucket_of, exact_percentiles

PERCENTS = (50.0, 95.0, 99.0)
PERCENT_NAMES = ("p50", "p95", "p99")


def payload_cycle(
    examples: DataFrame, order_by: Sequence[str | Column], requests: int
) -> DataFrame:
    """``requests`` rows, request i carrying example ``i mod count`` (runs a job).

    Examples with a schema and a question but no messages get those built from them. No
    examples is a ValueError.
    """
    if {"messages", "schema", "question"} <= set(examples.columns):
        rebuilt = messages_or_default(F.col("messages"), F.col("schema"), F.col("question"))
        examples = examples.withColumn("messages", rebuilt)
    indexed = number_rows(examples, order_by, name="example_index")
    count = indexed.count()
    if count == 0:
        raise ValueError("no examples to send")
    numbers = examples.sparkSession.range(requests).withColumnRenamed("id", "request_no")
    return numbers.withColumn("example_index", F.col("request_no") % count).join(
        indexed, "example_index"
    )


def request_numbers(
    log: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]
) -> DataFrame:
    """Add ``request_no``, 0 for the first request of each configuration (runs a job)."""
    return number_rows(log, order_by, keys, "request_no")


def measured(log: DataFrame, warmup: int) -> DataFrame:
    """The requests after the first ``warmup`` ones of a log with ``request_no``."""
    return log.where(F.col("request_no") >= warmup)


def drop_warmup(
    log: DataFrame, keys: Sequence[str], order_by: Sequence[str], warmup: int
) -> DataFrame:
    """Leave out the first ``warmup`` requests of each configuration.

    For logs without request numbers (runs a job). Only the order values of the
    warm-up requests are ranked: every task keeps at most ``warmup`` rows per
    configuration before the shuffle. The last warm-up request of each configuration
    is written out, so the planner knows whether that table is small enough to spare
    the log a shuffle. ``order_by`` must tell the requests of a configuration apart.
    """
    if warmup <= 0:
        return log
    first = Window.partitionBy(*keys).orderBy(*order_by)
    last_warmup = (
        log.select(*keys, *order_by)
        .withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= warmup)
        .groupBy(*keys)
        .agg(F.max(F.struct(*order_by)).alias("_last"))
    )
    joined = join_null_safe(log, materialise(last_warmup, "warmup"), keys)
    return joined.where(F.struct(*order_by) > F.col("_last")).drop("_last")


def latency_counts(log: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """The log counted by configuration, success and latency bucket.

    Everything a report needs except the exact percentiles can be added up from
    here, so the log is read once. Latencies are added up as whole milliseconds and
    nanoseconds: integers are fast, and unlike a sum of doubles theirs does not depend
    on the order in which tasks deliver their parts.
    """
    rows = weight or "1"
    return log.groupBy(*keys, "ok", bucket_of("latency_ms").alias("_bucket")).agg(
        F.expr(f"sum({rows}) AS _rows"),
        F.expr(f"coalesce(sum({rows}) FILTER (WHERE latency_ms IS NOT NULL), 0) AS _count"),
        F.expr("CAST(min(latency_ms) AS DOUBLE) AS _low"),
        F.expr("CAST(max(latency_ms) AS DOUBLE) AS _high"),
        F.expr(f"sum(floor(latency_ms) * {rows}) AS _millis"),
        F.expr(
            f"sum(CAST(rint((latency_ms - floor(latency_ms)) * 1e6D) AS BIGINT) * {rows}) AS _nanos"
        ),
        F.expr("sum(out_tokens) AS _tokens"),
        F.expr("min(start_ts) AS _start"),
        F.expr("max(end_ts) AS _end"),
    )


def latency_totals(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, extremes, mean, rates and wall time per configuration, unrounded."""
    return (
        counts.groupBy(*keys)
        .agg(
            F.expr("sum(_rows) AS num_requests"),
            F.expr("sum(_rows) - coalesce(sum(_rows) FILTER (WHERE ok), 0) AS failed"),
            F.expr("coalesce(sum(_rows) FILTER (WHERE ok), 0) AS _ok"),
            F.expr(
                "CAST(sum(_millis * 1000000BD + _nanos) FILTER (WHERE ok) AS DOUBLE) / 1e6D"
                " AS _total_ms"
            ),
            F.expr("max(_high) FILTER (WHERE ok) AS _max"),
            F.expr("coalesce(sum(_tokens) FILTER (WHERE ok), 0) AS output_tokens_total"),
            F.expr("(unix_micros(max(_end)) - unix_micros(min(_start))) / 1e6D AS _wall"),
        )
        .withColumns(
            {
                "_mean": rate("_total_ms", "_ok"),
                "_req": rate("_ok", "_wall"),
                "_tok": rate("output_tokens_total", "_wall"),
            }
        )
    )


def latency_report(
    log: DataFrame, keys: Sequence[str] = ("config",), weight: str | None = None
) -> DataFrame:
    """Nested latency report, one row per configuration (runs jobs).

    Statistics cover successful requests. Without any, percentiles are 0.0 while
    mean and maximum are NULL. ``weight`` names the number of requests a row stands
    for; its ``out_tokens`` are then the total of those requests.

    The counted log is written to the shared folder, and totals and ranks come from
    there. The log itself is read a second time only where a percentile falls into a
    bucket of several values, and then only those buckets get past the first filter.
    """
    keys = list(keys)
    counts = materialise(latency_counts(log, keys, weight), "latencies")
    percentiles = exact_percentiles(
        log.where("ok"), keys, "latency_ms", PERCENTS, PERCENT_NAMES, weight,
        histogram=counts.where("ok AND _count > 0"),
    )
    return _nested_report(latency_totals(counts, keys), percentiles, keys)


def approximate_report(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same report from ``latency_counts`` alone (runs jobs).

    Percentiles are exact to the width of a bucket, about one part in 4096; everything
    else is exact.
    """
    keys = list(keys)
    middles = counts.where("ok AND _count > 0").select(
        *keys, F.expr("_low + (_high - _low) / 2 AS latency_ms"), "_count"
    )
    percentiles = exact_percentiles(
        middles, keys, "latency_ms", PERCENTS, PERCENT_NAMES, "_count"
    )
    return _nested_report(latency_totals(counts, keys), percentiles, keys)


def _nested_report(totals: DataFrame, percentiles: DataFrame, keys: list[str]) -> DataFrame:
    report = join_null_safe(totals, percentiles, keys, "left").na.fill(0.0, list(PERCENT_NAMES))
    return report.select(
        *keys,
        "num_requests",
        "failed",
        round_half_even("_wall", 3).alias("wall_seconds"),
        F.struct(
            round_half_even("_mean", 1).alias("mean"),
            *[round_half_even(name, 1).alias(name) for name in PERCENT_NAMES],
            round_half_even("_max", 1).alias("max"),
        ).alias("latency_ms"),
        F.struct(
            round_half_even("_req", 2).alias("requests_per_sec"),
            round_half_even("_tok", 1).alias("output_tokens_per_sec"),
        ).alias("throughput"),
        "output_tokens_total",
    )


def peak_memory(
    samples: DataFrame, configs: DataFrame | None = None, key: str = "config"
) -> DataFrame:
    """Highest ``used_mib`` per configuration; -1 for those of ``configs`` without samples."""
    peaks = samples.groupBy(key).agg(F.max("used_mib").alias("peak_gpu_mem_mib"))
    if configs is not None:
        peaks = configs.select(key).distinct().join(peaks, key, "left")
    return peaks.withColumn("peak_gpu_mem_mib", F.coalesce("peak_gpu_mem_mib", F.lit(-1)))


def running_peak(samples: DataFrame, key: str = "config", chunk: str = "minute") -> DataFrame:
    """Peak memory so far at every sampling time, over all devices sampled then.

    ``chunk`` is the stretch of time one task scans for one configuration.
    """
    per_time = samples.groupBy(key, "ts").agg(F.max("used_mib").alias("used_mib"))
    return running_max(
        per_time, [key], "ts", "used_mib", F.date_trunc(chunk, F.col("ts")), "peak_mib"
    )


def log_from_calls(calls: DataFrame) -> DataFrame:
    """Request log rows from the records of ``timed_calls``."""
    return calls.withColumn("latency_ms", F.col("latency") * 1000.0)


def with_labels(report: DataFrame, labels: dict[str, str | int | None]) -> DataFrame:
    """The report with columns that say what was measured, such as ``model``,
    ``base_url``, ``concurrency`` and ``max_new_tokens``."""
    types = {"concurrency": "int", "max_new_tokens": "int"}
    return report.withColumns(
        {name: F.lit(value).cast(types.get(name, "string")) for name, value in labels.items()}
    )
