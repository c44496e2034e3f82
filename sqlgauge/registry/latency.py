"""Request logs, memory samples and the stream over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import latency as L
from ..session import new_path
from ..streaming.latency import start_window_reports
from .base import query, sql_percentile, sql_round, table

# Events as a request log. The second engine gets the same columns from LOG_SQL.
LOG_SQL = """
log AS (
  SELECT event_id, 'u' || user_id AS config, event_type <> 'error' AS ok, value AS v,
    CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS tokens,
    epoch_us(ts) AS start_us, epoch_us(ts) + CAST(round(value * 1000) AS BIGINT) AS end_us
  FROM events
)
"""


def request_log(events: DataFrame) -> DataFrame:
    start = F.col("ts").cast("timestamp")
    micros = F.round(F.col("value") * 1000).cast("bigint")
    ok = F.col("event_type") != "error"
    return events.select(
        "event_id",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("config"),
        ok.alias("ok"),
        F.col("value").alias("latency_ms"),
        F.when(ok, F.get_json_object("props", "$.k").cast("bigint")).alias("out_tokens"),
        start.alias("start_ts"),
        F.timestamp_micros(F.unix_micros(start) + micros).alias("end_ts"),
    )


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log(table(spark, sf_dir, "events"))


def flat(report: DataFrame) -> DataFrame:
    """The nested report as plain columns."""
    kept = [c for c in report.columns if c not in ("latency_ms", "throughput")]
    return report.select(*kept, "latency_ms.*", "throughput.*")


def sql_report(keys: str, log: str = "log") -> str:
    """CTEs ending in ``report`` with the columns of ``flat`` over ``log``."""
    return f"""
ranked AS (
  SELECT {keys}, v, row_number() OVER (PARTITION BY {keys} ORDER BY v) - 1 AS i,
    count(*) OVER (PARTITION BY {keys}) AS n
  FROM {log} WHERE ok
),
percentiles AS (
  SELECT {keys}, {sql_percentile(50)} AS p50, {sql_percentile(95)} AS p95, {sql_percentile(99)} AS p99
  FROM ranked GROUP BY {keys}
),
totals AS (
  SELECT {keys}, count(*) AS num_requests, count(*) FILTER (WHERE NOT ok) AS failed,
    CAST(sum(CAST(round(v * 1000000) AS HUGEINT)) FILTER (WHERE ok) AS DOUBLE) / 1000000.0::DOUBLE
      / nullif(CAST(count(*) FILTER (WHERE ok) AS DOUBLE), 0) AS mean,
    max(v) FILTER (WHERE ok) AS max_v,
    coalesce(sum(coalesce(tokens, 0)) FILTER (WHERE ok), 0)::BIGINT AS output_tokens_total,
    CAST(max(end_us) - min(start_us) AS DOUBLE) / 1000000.0::DOUBLE AS wall,
    CAST(count(*) FILTER (WHERE ok) AS DOUBLE) AS good
  FROM {log} GROUP BY {keys}
),
report AS (
  SELECT {keys}, num_requests, failed, {sql_round('wall', 3)} AS wall_seconds, output_tokens_total,
    {sql_round('mean', 1)} AS mean, {sql_round('coalesce(p50, 0.0)', 1)} AS p50,
    {sql_round('coalesce(p95, 0.0)', 1)} AS p95, {sql_round('coalesce(p99, 0.0)', 1)} AS p99,
    {sql_round('max_v', 1)} AS max,
    {sql_round('good / nullif(wall, 0)', 2)} AS requests_per_sec,
    {sql_round('output_tokens_total::DOUBLE / nullif(wall, 0)', 1)} AS output_tokens_per_sec
  FROM totals LEFT JOIN percentiles USING ({keys})
)
"""


@query(f"WITH {LOG_SQL}, {sql_report('config')} SELECT * FROM report")
def latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles, failures and throughput per configuration."""
    return flat(L.latency_report(_log(spark, sf_dir)))


@query(f"""
WITH {LOG_SQL},
measured AS (
  SELECT * FROM log
  QUALIFY row_number() OVER (PARTITION BY config ORDER BY start_us, event_id) > 8
),
{sql_report('config', 'measured')}
SELECT * FROM report
""")
def latency_warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the first eight requests of each configuration."""
    measured = L.drop_warmup(_log(spark, sf_dir), ["config"], ["start_ts", "event_id"], 8)
    return flat(L.latency_report(measured))


@query(f"""
WITH {LOG_SQL}
SELECT event_id, config,
  row_number() OVER (PARTITION BY config ORDER BY start_us, event_id) - 1 AS request_no
FROM log
QUALIFY request_no >= 8
""")
def request_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured requests with their position in the log of their configuration."""
    log = _log(spark, sf_dir).select("event_id", "config", "start_ts")
    numbered = L.request_numbers(log, ["config"], ["start_ts", "event_id"])
    return L.measured(numbered, 8).select("event_id", "config", "request_no")


def samples(events: DataFrame) -> DataFrame:
    """Event values as memory samples."""
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("config"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 100).cast("bigint").alias("used_mib"),
    )


@query("""
SELECT 'u' || c_custkey AS config, coalesce(max(CAST(round(value * 100) AS BIGINT)), -1) AS peak_gpu_mem_mib
FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey
""")
def peak_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak memory per configuration, here one per customer, -1 where nothing was sampled."""
    names = F.concat(F.lit("u"), F.col("c_custkey").cast("string"))
    configs = table(spark, sf_dir, "customer").select(names.alias("config"))
    return L.peak_memory(samples(table(spark, sf_dir, "events")), configs)


@query("""
WITH per_time AS (
  SELECT 'u' || user_id AS config, epoch_us(ts) AS ts_us, max(CAST(round(value * 100) AS BIGINT)) AS used_mib
  FROM events GROUP BY ALL
)
SELECT config, ts_us, used_mib, max(used_mib) OVER (PARTITION BY config ORDER BY ts_us) AS peak_mib
FROM per_time
""")
def running_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak memory so far at every sampling time."""
    peaks = L.running_peak(samples(table(spark, sf_dir, "events")), chunk="hour")
    return peaks.select("config", F.unix_micros("ts").alias("ts_us"), "used_mib", "peak_mib")


@query("""
WITH indexed AS (
  SELECT item_id, length(text) AS question_length, row_number() OVER (ORDER BY item_id) - 1 AS example_index
  FROM benchmark
)
SELECT range AS request_no, item_id, question_length
FROM range((SELECT count(*) FROM events)) JOIN indexed
  ON example_index = range % (SELECT count(*) FROM benchmark)
""")
def payload_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many requests as there were events, cycling through the benchmark questions."""
    questions = table(spark, sf_dir, "benchmark")
    requests = table(spark, sf_dir, "events").count()
    return L.payload_cycle(questions, ["item_id"], requests).select(
        "request_no", "item_id", F.length("text").alias("question_length")
    )


@query(f"""
WITH {LOG_SQL},
windowed AS (
  SELECT *, start_us // 21600000000 AS w FROM log
),
closed AS (
  SELECT *, w * 21600 AS window_start FROM windowed
  WHERE (w + 1) * 21600000000 <= (SELECT max(start_us) FROM log) // 1000 * 1000 - 3600000000
),
{sql_report('window_start, config', 'closed')}
SELECT * FROM report
""")
def stream_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports per six-hour window from a stream over the events, up to the watermark."""
    schema = table(spark, sf_dir, "events").schema
    # As a glob the path may be a folder of files or, which a stream refuses otherwise, a file.
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    out = new_path(spark, "windows")
    running = start_window_reports(
        request_log(events), out, new_path(spark, "stream"), "6 hours", "1 hour",
        availableNow=True,
    )
    running.awaitTermination()
    report = flat(spark.read.parquet(out).drop("batch_id"))
    return report.withColumn("window_start", F.unix_timestamp("window_start")).drop("window_end")
