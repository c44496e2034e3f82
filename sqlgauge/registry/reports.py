"""Summaries of configurations and the Pareto front."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import latency as L
from ..operators import pareto as P
from ..operators import score as S
from ..operators.ordering import number_rows
from ..plans.summary import summarise
from ..session import new_path
from ..sources import reports as R
from .base import query, sql_round, table
from .latency import LOG_SQL, request_log, samples, sql_report

# Accuracy goes by the event's property k and speed by its user, so that some
# configurations have both reports and some only one.
_VERDICT = "CASE WHEN event_type IN ('purchase', 'click') THEN 'match' WHEN event_type = 'error' THEN 'pred_error: x' ELSE 'mismatch' END"
_SUMMARY_SQL = f"""
{LOG_SQL},
verdicts AS (
  SELECT 'u' || CAST(json_extract(props, '$.k') AS BIGINT) AS config, {_VERDICT} AS status FROM events
),
accuracy AS (
  SELECT config, count(*) AS n, count(*) FILTER (WHERE status = 'match') AS correct,
    {sql_round("count(*) FILTER (WHERE status = 'match')::DOUBLE / count(*)::DOUBLE", 4)} AS execution_accuracy
  FROM verdicts GROUP BY config
),
{sql_report('config')},
memory AS (SELECT config, max(CAST(round(v * 100) AS BIGINT)) AS peak_gpu_mib FROM log GROUP BY config),
joined AS (
  SELECT config, execution_accuracy, p50 AS p50_ms, p95 AS p95_ms, p99 AS p99_ms,
    requests_per_sec AS req_per_sec, output_tokens_per_sec AS tok_per_sec, peak_gpu_mib
  FROM accuracy FULL JOIN (SELECT * FROM report JOIN memory USING (config)) USING (config)
),
points AS (SELECT * FROM joined WHERE execution_accuracy <> 0 AND p99_ms <> 0),
summary AS (
  SELECT *, coalesce(execution_accuracy <> 0 AND p99_ms <> 0, false) AND NOT EXISTS (
    SELECT 1 FROM points b
    WHERE b.execution_accuracy >= a.execution_accuracy AND b.p99_ms <= a.p99_ms
      AND (b.execution_accuracy > a.execution_accuracy OR b.p99_ms < a.p99_ms)
  ) AS pareto
  FROM joined a
)
"""


def _reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Accuracy and latency reports."""
    events = table(spark, sf_dir, "events")
    verdicts = events.select(
        F.concat(F.lit("u"), F.get_json_object("props", "$.k")).alias("config"),
        F.expr(_VERDICT).alias("status"),
    )
    accuracy = S.metrics(
        verdicts.withColumn("correct", F.col("status") == "match"), ["config"]
    )
    latency = L.latency_report(request_log(events)).join(L.peak_memory(samples(events)), "config")
    return accuracy, latency


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.join_reports(*_reports(spark, sf_dir))


_BY_ACCURACY = (
    "row_number() OVER (ORDER BY coalesce(execution_accuracy, 0) DESC, config) - 1 AS rank"
)


@query(f"WITH {_SUMMARY_SQL} SELECT *, {_BY_ACCURACY} FROM summary")
def config_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports side by side with the Pareto flag, best accuracy first."""
    return P.summary_table(summarise(_summary(spark, sf_dir)))


@query(f"""
WITH {_SUMMARY_SQL}
SELECT config, p99_ms, execution_accuracy,
  row_number() OVER (ORDER BY p99_ms, config) - 1 AS rank
FROM summary
WHERE pareto AND (SELECT count(*) FROM summary WHERE pareto) > 1
""")
def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Pareto front by rising latency."""
    front = P.frontier(summarise(_summary(spark, sf_dir)))
    return front.select("config", "p99_ms", "execution_accuracy", "rank")


_DELTA_SQL = """
delta AS (
  SELECT s.config, s.execution_accuracy, s.p99_ms, s.req_per_sec, s.peak_gpu_mib,
    (b.p99_ms - s.p99_ms) / nullif(b.p99_ms, 0) * 100.0::DOUBLE AS p99_cut_pct,
    (s.req_per_sec - b.req_per_sec) / nullif(b.req_per_sec, 0) * 100.0::DOUBLE AS throughput_lift_pct,
    (b.execution_accuracy - s.execution_accuracy) * 100.0::DOUBLE AS accuracy_loss_pp
  FROM summary s LEFT JOIN summary b ON b.config = 'u1'
),
checked AS (SELECT *, coalesce(accuracy_loss_pp < 2, false) AS within_loss FROM delta)
"""


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.baseline_delta(summarise(_summary(spark, sf_dir)), "u1")


@query(f"""
WITH {_SUMMARY_SQL}, {_DELTA_SQL}
SELECT config, p99_cut_pct, throughput_lift_pct, accuracy_loss_pp, within_loss FROM checked
""")
def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configuration against the baseline 'u1'."""
    return _delta(spark, sf_dir).select(
        "config", "p99_cut_pct", "throughput_lift_pct", "accuracy_loss_pp", "within_loss"
    )


@query(f"""
WITH {_SUMMARY_SQL}, {_DELTA_SQL}
SELECT CASE WHEN peak_gpu_mib > 20000 THEN 'gpu' ELSE 'cpu' END AS stack, config, p99_ms, execution_accuracy
FROM checked WHERE within_loss AND p99_ms IS NOT NULL
QUALIFY row_number() OVER (
  PARTITION BY stack ORDER BY p99_ms, execution_accuracy DESC, config
) = 1
""")
def best_per_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fastest configuration of each stack within the accuracy loss allowed."""
    stack = F.when(F.col("peak_gpu_mib") > 20000, "gpu").otherwise("cpu")
    return P.best_per_stack(_delta(spark, sf_dir).withColumn("stack", stack))


@query("""
SELECT p_partkey AS config, coalesce(p_size <> 0 AND p_retailprice <> 0, false) AND NOT EXISTS (
  SELECT 1 FROM part b
  WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice
    AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice)
    AND b.p_size <> 0 AND b.p_retailprice <> 0
) AS pareto
FROM part a
""")
def pareto_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front over many points: large and cheap parts."""
    points = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("config"),
        F.col("p_size").cast("double").alias("execution_accuracy"),
        F.col("p_retailprice").alias("p99_ms"),
    )
    return P.flag_pareto(points).select("config", "pareto")


@query(f"""
WITH {_SUMMARY_SQL}
SELECT config, a.n, a.correct, a.execution_accuracy, r.p99 AS p99_ms, r.num_requests,
  CASE WHEN a.config IS NOT NULL THEN (SELECT count(*) FROM verdicts v WHERE v.config = a.config AND v.status = 'mismatch') END AS mismatches
FROM accuracy a FULL JOIN report r USING (config)
""")
def report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written as JSON per configuration, read back and joined."""
    accuracy, latency = _reports(spark, sf_dir)
    paths = {}
    for name, report in (("metrics", accuracy), ("latency", latency)):
        paths[name] = new_path(spark, name)
        R.write_reports(report, paths[name])
    accuracy = R.read_reports(spark, paths["metrics"], R.METRICS_TYPE)
    latency = R.read_reports(spark, paths["latency"], R.LATENCY_TYPE)
    mismatches = F.coalesce(F.try_element_at("status_counts", F.lit("mismatch")), F.lit(0))
    return accuracy.select(
        "config", "n", "correct", "execution_accuracy", mismatches.alias("mismatches")
    ).join(
        latency.select("config", F.col("latency_ms.p99").alias("p99_ms"), "num_requests"),
        "config", "full_outer",
    )


@query(f"""
WITH {_SUMMARY_SQL}
SELECT *, row_number() OVER (ORDER BY config) - 1 AS rank FROM summary
""")
def summary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary written as CSV by configuration and read back, with the place of each."""
    path = new_path(spark, "summary")
    ranked = number_rows(summarise(_summary(spark, sf_dir)), ["config"], name="rank")
    R.write_summary(ranked, path)
    schema = (
        "config string, execution_accuracy double, p50_ms double, p95_ms double, p99_ms double, "
        "req_per_sec double, tok_per_sec double, peak_gpu_mib bigint, pareto boolean, rank bigint"
    )
    return spark.read.schema(schema).option("header", True).csv(path)


@query(f"""
WITH {_SUMMARY_SQL}
SELECT * EXCLUDE (pareto) FROM summary
""")
def results_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all configurations written as a results tree, a folder each, and read back."""
    root = new_path(spark, "tree")
    accuracy, latency = _reports(spark, sf_dir)
    R.write_results_tree(accuracy, root, "metrics.json")
    R.write_results_tree(latency, root, "latency.json")
    return R.read_results_tree(spark, root)
