import json
import random

import pytest
from pyspark.sql import functions as F

from sqlgauge.operators import pareto as P
from sqlgauge.plans.summary import summarise, summarise_tree
from sqlgauge.sources.reports import read_results_tree

SUMMARY = (
    "config string, execution_accuracy double, p50_ms double, p95_ms double, p99_ms double, "
    "req_per_sec double, tok_per_sec double, peak_gpu_mib bigint"
)


def brute_force(points):
    usable = {c: (a, p) for c, a, p in points if a and p}
    return {
        c for c, (a, p) in usable.items()
        if not any(b >= a and q <= p and (b > a or q < p) for b, q in usable.values())
    }


def frame(spark, points):
    return spark.createDataFrame(points, "config string, execution_accuracy double, p99_ms double")


@pytest.mark.parametrize("digits", [0, 1, 6])
def test_front_equals_pairwise_definition(spark, digits):
    rng = random.Random(digits)
    points = []
    for i in range(1500):
        p99 = round(rng.lognormvariate(5, 2), digits)
        accuracy = round(min(1.0, 0.1 * rng.random() + 0.06 * len(str(int(p99)))), digits + 2)
        points.append((f"c{i}", rng.choice([accuracy] * 9 + [None, 0.0]), p99))
    points += [("z", 0.5, 0.0), ("n", 0.9, None)]
    got = {r.config for r in P.flag_pareto(frame(spark, points)).where("pareto").collect()}
    assert got == brute_force(points)


def test_equal_points_share_the_front(spark):
    points = [("a", 0.8, 10.0), ("b", 0.8, 10.0), ("c", 0.7, 10.0), ("d", 0.8, 11.0)]
    got = {r.config for r in P.flag_pareto(frame(spark, points)).where("pareto").collect()}
    assert got == {"a", "b"}


def test_frontier_needs_two_points(spark):
    flagged = P.flag_pareto(frame(spark, [("a", 0.8, 10.0), ("b", 0.9, 20.0), ("c", 0.1, 30.0)]))
    assert [r.config for r in P.frontier(flagged).collect()] == ["a", "b"]
    single = P.flag_pareto(frame(spark, [("a", 0.8, 10.0), ("c", 0.1, 30.0)]))
    assert P.frontier(single).count() == 0


def full(spark):
    rows = [
        ("base", 0.80, 1.0, 2.0, 100.0, 10.0, 50.0, 4000),
        ("fast", 0.79, 1.0, 2.0, 40.0, 15.0, 60.0, 2000),
        ("weak", 0.60, 1.0, 2.0, 20.0, 30.0, 90.0, -1),
        ("unscored", None, 1.0, 2.0, 30.0, 20.0, 70.0, 1),
    ]
    return spark.createDataFrame(rows, SUMMARY)


def test_baseline_and_best(spark):
    delta = P.baseline_delta(full(spark), "base")
    got = {r.config: r for r in delta.collect()}
    assert got["fast"].p99_cut_pct == pytest.approx(60.0)
    assert got["fast"].throughput_lift_pct == pytest.approx(50.0)
    assert got["fast"].accuracy_loss_pp == pytest.approx(1.0)
    assert [got[c].within_loss for c in ("base", "fast", "weak", "unscored")] == [
        True, True, False, False,
    ]
    stacked = delta.withColumn("stack", F.when(F.col("config") == "base", "cpu").otherwise("gpu"))
    best = {r.stack: r.config for r in P.best_per_stack(stacked).collect()}
    assert best == {"cpu": "base", "gpu": "fast"}


def test_table_order(spark):
    table = P.summary_table(summarise(full(spark)))
    assert table.columns == [*P.SUMMARY_COLUMNS, "rank"]
    assert [r["rank"] for r in table.collect()] == [0, 1, 2, 3]
    assert [r.config for r in table.collect()] == ["base", "fast", "weak", "unscored"]


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, indent=2))


def test_results_tree(spark, tmp_path, rows):
    root = tmp_path / "results"
    latency = {"latency_ms": {"p50": 1.0, "p99": 9.5}, "throughput": {}, "peak_gpu_mem_mib": -1}
    write(root / "a b+c" / "metrics.json", {"execution_accuracy": 0.5, "adapter": None})
    write(root / "a b+c" / "latency.json", latency)
    write(root / "only_speed" / "latency.json", {"latency_ms": {"p99": 3.0}})
    write(root / "only_score" / "metrics.json", {"execution_accuracy": 0.9})
    write(root / "deep" / "er" / "metrics.json", {"execution_accuracy": 0.1})
    write(root / "none" / "other.json", {})
    out = str(tmp_path / "summary")
    got = {r.config: r for r in summarise_tree(spark, str(root), out).collect()}
    assert set(got) == {"a b+c", "only_speed", "only_score"}
    both = got["a b+c"]
    assert (both.execution_accuracy, both.p50_ms, both.p95_ms, both.p99_ms) == (0.5, 1.0, None, 9.5)
    assert both.pareto and both.peak_gpu_mib == -1 and not got["only_speed"].pareto
    header, *lines = [
        line for part in sorted((tmp_path / "summary").glob("part-*.csv"))
        for line in part.read_text().splitlines()
    ]
    assert header == ",".join(P.SUMMARY_COLUMNS)
    assert lines[0] == "a b+c,0.5,1.0,,9.5,,,-1,true"


def test_empty_tree_is_an_error(spark, tmp_path):
    (tmp_path / "x").mkdir()
    with pytest.raises(ValueError):
        read_results_tree(spark, str(tmp_path))
