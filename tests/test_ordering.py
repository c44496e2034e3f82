import random

import pytest
from pyspark.sql import functions as F

from sqlgauge.operators.ordering import batch_numbers, number_rows, running_max


def test_numbers_with_one_hot_key(spark, rows):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.6 else rng.choice("ab"), i) for i in range(5000)]
    data += [(None, i) for i in range(20)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, v bigint").repartition(6)
    got = rows(number_rows(df, ["v"], ["k"], "no").select("k", "v", "no"))
    assert len(got) == len(data)
    for key in {k for k, _ in data}:
        values = sorted((v, no) for k, v, no in got if k == key)
        assert [no for _, no in values] == list(range(len(values)))


def test_numbers_over_the_whole_table(spark, rows):
    df = spark.range(1000).withColumn("v", F.hash("id")).repartition(9)
    got = rows(number_rows(df, [F.desc("v"), "id"]).orderBy("row_no"))
    assert got == sorted(((i, v, n) for i, v, n in got), key=lambda r: (-r[1], r[0]))
    assert [n for *_, n in got] == list(range(1000))


def test_numbers_of_nothing(spark):
    assert number_rows(spark.range(0), ["id"]).count() == 0


def test_order_is_required_per_key(spark):
    with pytest.raises(ValueError):
        number_rows(spark.range(3), None, ["id"])


def test_batches(spark, rows):
    got = dict(rows(batch_numbers(spark.range(10).repartition(3), ["id"], 4)))
    assert got == {i: i // 4 for i in range(10)}


def test_running_max(spark, rows):
    rng = random.Random(2)
    data = [(k, t, rng.randint(0, 1000)) for k in ("a", "b", None) for t in range(300)]
    df = spark.createDataFrame(data, "k string, t bigint, v bigint").repartition(5)
    got = rows(running_max(df, ["k"], "t", "v", F.floor(F.col("t") / 17), "peak"))
    assert len(got) == len(data)
    values = {(k, t): v for k, t, v in data}
    for k, t, _, peak in got:
        assert peak == max(values[k, i] for i in range(t + 1))
