import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sqlgauge.operators.compare import compare_results, mismatch_rows, pair_results, results_match

from test_numbers import python_cell


def equal(spark, gold, pred, schema_gold, schema_pred, ordered=False):
    a = spark.createDataFrame(gold, schema_gold)
    b = spark.createDataFrame(pred, schema_pred)
    return results_match(a, b, ordered).first()["results_equal"]


def test_multiset_or_ordered(spark):
    rows = [("oslo", "fog"), ("rome", "sun"), ("oslo", "sun")]
    turned = [rows[2], rows[0], rows[1]]
    schema = "town string, sky string"
    assert equal(spark, rows, turned, schema, schema)
    assert not equal(spark, rows, turned, schema, schema, ordered=True)
    assert equal(spark, turned, turned, schema, schema, ordered=True)


@pytest.mark.parametrize(
    "gold, gold_type, pred, pred_type, want",
    [
        (7, "bigint", 7.0, "float", True),
        (-20, "int", "-20", "string", True),
        (8, "int", 8.25, "double", False),
        (0.125, "double", 0.125, "float", True),
        ("", "string", None, "double", True),
        (7, "int", "7.00", "string", False),
    ],
)
def test_cell_equality(spark, gold, gold_type, pred, pred_type, want):
    got = equal(spark, [(gold,)], [(pred,)], f"a {gold_type}", f"b {pred_type}")
    assert got is want


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_decimals_never_have_an_exponent(spark, ansi):
    from sqlgauge.functions.canonical import canonical_cell
    from pyspark.sql import types as T

    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        texts = ["0", "0.0000001", "-12.5000000000", "1234567.25"]
        df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(
            "CAST(t AS DECIMAL(20,10)) AS d"
        )
        got = [r[0] for r in df.select(canonical_cell("d", T.DecimalType(20, 10))).collect()]
        assert got == ["0", "0.0000001", "-12.5", "1234567.25"]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_duplicates_arity_and_empty(spark):
    assert not equal(spark, [(1,), (1,)], [(1,)], "a int", "a int")
    assert not equal(spark, [(1, None)], [(1,)], "a int, b string", "a int")
    assert equal(spark, [], [], "a int, b string", "a int")
    assert equal(spark, [], [], "a int", "a int", ordered=True)


def test_repeated_column_names(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS a")
    assert results_match(df, df, False).first()["results_equal"]


def test_order_is_kept_over_many_partitions(spark):
    up = spark.range(5000).repartition(7).orderBy("id")
    down = spark.range(5000).repartition(5).orderBy(F.desc("id"))
    assert results_match(up, up, True).first()["results_equal"]
    assert tuple(results_match(up, down, True).first()) == (False, 5000, 5000)
    assert results_match(up, down, False).first()["results_equal"]
    numbers = pair_results(up, down, True).where("side = 'gold'").select("row_no", "cells")
    assert all(str(n) == cells[0] for n, cells in numbers.collect())


def test_many_random_examples_against_counters(spark):
    rng = random.Random(7)
    gold, pred = {}, {}
    for example in range(150):
        def bag(width):
            return [
                tuple(rng.choice([None, "", 1, "1", 2]) for _ in range(width))
                for _ in range(rng.randint(0, 4))
            ]
        gold[example] = bag(rng.choice([1, 2]))
        pred[example] = list(gold[example]) if rng.random() < 0.5 else bag(rng.choice([1, 2]))
        rng.shuffle(pred[example])
    data = []
    for side, results in (("gold", gold), ("pred", pred)):
        for example, bag in results.items():
            ordered = example % 3 == 0
            for i, row in enumerate(bag):
                data.append((example, side, i if ordered else None, [python_cell(c) for c in row]))
    long = spark.createDataFrame(
        data, "example_id bigint, side string, row_no bigint, cells array<string>"
    )
    got = {r.example_id: r for r in compare_results(long).collect()}
    diff = {r.example_id for r in mismatch_rows(long).select("example_id").collect()}
    for example in gold:
        g = [tuple(map(python_cell, r)) for r in gold[example]]
        p = [tuple(map(python_cell, r)) for r in pred[example]]
        want = g == p if example % 3 == 0 else Counter(g) == Counter(p)
        if not g and not p:
            assert example not in got
            continue
        assert got[example].results_equal == want
        assert (got[example].gold_rows, got[example].pred_rows) == (len(g), len(p))
        assert (example in diff) == (not want)


def test_rounding_option(spark):
    a = spark.createDataFrame([(0.1 + 0.2,)], "a double")
    b = spark.createDataFrame([(0.3,)], "a double")
    assert not results_match(a, b, False).first()["results_equal"]
    assert results_match(a, b, False, digits=9).first()["results_equal"]
