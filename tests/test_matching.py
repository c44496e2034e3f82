import pytest
from pyspark.sql import functions as F

from sqlgauge.registry import matching

PER_TASK = 500


def _tables(spark, folder, n_orders):
    """Orders of four line items each, under the names the queries read."""
    orders = spark.range(n_orders).selectExpr(
        "id AS o_orderkey", "concat('p', id % 5) AS o_orderpriority",
        "substr('FOP', 1 + id % 3, 1) AS o_orderstatus", "120000D + id AS o_totalprice",
    )
    orders.write.parquet(f"{folder}/orders.parquet")
    items = spark.range(4 * n_orders).selectExpr(
        "id DIV 4 AS l_orderkey", "CAST(1 + id % 4 AS INT) AS l_linenumber", "id AS l_partkey",
        "CAST(id % 50 AS DOUBLE) AS l_quantity", "0.1D AS l_discount", "0.08D AS l_tax",
    )
    items.write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("n_orders", [2000, 8000])
@pytest.mark.parametrize("name", ["accuracy_by_config", "score_pairs", "status_counts", "predictions_json"])
def test_judging_tasks_grow_in_number_not_in_size(spark, tmp_path, monkeypatch, name, n_orders):
    verdicts, score_examples = [], matching.S.score_examples

    def kept(*tables):
        verdicts.append(score_examples(*tables))
        return verdicts[-1]

    monkeypatch.setattr(matching.S, "score_examples", kept)
    monkeypatch.setattr(matching, "_ROWS_PER_TASK", PER_TASK, raising=False)
    getattr(matching, name)(spark, _tables(spark, tmp_path, n_orders))
    shares = [r["count"] for r in verdicts[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == n_orders
    assert 5 * max(shares) <= 2 * PER_TASK
