"""Latency reports over tumbling windows of a live request log.

The stream keeps, per window, how often each latency occurred, or, for wide windows, how
many fell into each narrow bucket. That state spreads over the cluster by latency, however
busy one configuration is. When the watermark closes a window all its counts leave in the
same micro-batch, and the report is computed from them as an ordinary batch. Windows that
the watermark has not closed when the stream ends are not reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.latency import approximate_report, latency_counts, latency_report
from ..session import materialise, shared_tables

KEYS = ["window_start", "window_end", "config"]


def window_counts(log: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Requests counted by window, configuration, success and latency.

    Rows later than the watermark are dropped. ``start_ts`` must be a TIMESTAMP.
    """
    return (
        log.withWatermark("start_ts", delay)
        .groupBy(F.window("start_ts", window), "config", "ok", "latency_ms")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.coalesce("out_tokens", F.lit(0))).alias("out_tokens"),
            F.min("start_ts").alias("start_ts"),
            F.max("end_ts").alias("end_ts"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "config", "ok", "latency_ms", "n", "out_tokens", "start_ts", "end_ts",
        )
    )


def window_buckets(log: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """The same counted by latency bucket, so the state does not grow with the requests."""
    timed = log.withWatermark("start_ts", delay).withColumn("window", F.window("start_ts", window))
    counts = latency_counts(timed, ["window", "config"])
    return counts.withColumns(
        {"window_start": F.col("window.start"), "window_end": F.col("window.end")}
    ).drop("window")


def window_report(counts: DataFrame) -> DataFrame:
    """Latency report per window and configuration from ``window_counts``."""
    return latency_report(counts, KEYS, weight="n")


def start_window_reports(
    log: DataFrame,
    out: str,
    checkpoint: str,
    window: str = "1 hour",
    delay: str = "10 minutes",
    exact: bool = True,
    **trigger,
) -> StreamingQuery:
    """Start the stream. Reports of closed windows go to ``out`` as parquet.

    Every micro-batch overwrites its own folder, so a repeated one leaves no double, and
    deletes its intermediate tables. ``exact=False`` keeps buckets instead of latencies
    and gives percentiles to about one part in 4096.
    """

    def write(counts: DataFrame, batch_id: int) -> None:
        with shared_tables(counts.sparkSession):
            kept = materialise(counts, "closed")
            if not kept.isEmpty():
                report = window_report(kept) if exact else approximate_report(kept, KEYS)
                report.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    counted = window_counts if exact else window_buckets
    return (
        counted(log, window, delay)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .foreachBatch(write)
        .start()
    )
