import pytest
from pyspark.sql import functions as F

from sqlgauge.operators.score import (
    execution_accuracy, metrics, outcomes_by_example, score_examples, status_counts,
)
from sqlgauge.plans.runner import QueryError, QueryTimeout, evaluate, execution_match, run_query

SLOW = "SELECT count(*) FROM range(10000000000) a JOIN range(1000) b ON a.id % 7 <> b.id"


def nums(session, db_id):
    if db_id != "nums":
        raise ValueError(f"unknown database {db_id}")
    session.sql("SELECT * FROM VALUES (1), (2), (3) AS t(n)").createOrReplaceTempView("nums")


def test_run_query_keeps_order(spark):
    rows = run_query(spark, "nums", "SELECT n FROM nums ORDER BY n DESC", use_database=nums)
    assert [r[0] for r in rows.collect()] == [3, 2, 1]


@pytest.mark.parametrize(
    "query",
    [
        "INSERT INTO nums VALUES (4)", "CREATE TABLE x AS SELECT 1", "DROP VIEW nums",
        "SELECT 1; SELECT 2", "SELECT bad syntax (", "SELECT * FROM no_such_table",
        "SELECT raise_error('boom')",
    ],
)
def test_only_reading_statements_run(spark, query):
    with pytest.raises(QueryError):
        run_query(spark, "nums", query, use_database=nums)


def test_trailing_comment_and_double_names(spark):
    rows = run_query(spark, "nums", "SELECT n, n FROM nums -- all", use_database=nums)
    assert rows.count() == 3


def test_untyped_null_column(spark):
    rows = run_query(spark, "nums", "SELECT NULL, n FROM nums ORDER BY n", use_database=nums)
    assert [tuple(r) for r in rows.collect()] == [(None, 1), (None, 2), (None, 3)]


def test_timeout(spark):
    with pytest.raises(QueryTimeout):
        run_query(spark, "nums", SLOW, timeout=2, use_database=nums)


CASES = [
    ("SELECT max(n) FROM nums", "SELECT 3", "match"),
    ("SELECT n * 2 FROM nums", "SELECT n + n AS twice FROM nums ORDER BY twice DESC", "match"),
    ("SELECT n * 2 FROM nums", "SELECT n * n FROM nums", "mismatch"),
    ("SELECT -n FROM nums order BY 1", "SELECT -n FROM nums ORDER BY 1 DESC", "mismatch"),
    ("SELECT -n FROM nums order BY 1", "SELECT 0 - n FROM nums ORDER BY n DESC", "match"),
    ("SELECT min(n) FROM nums", "SELEC min(n) FROM nums", "pred_error"),
    ("SELECT min(n) FROM nums", "\n\t ", "pred_error: empty"),
    ("SELECT min(n) FROM nums", None, "pred_error: empty"),
    ("SELECT m FROM nums", "SELECT min(n) FROM nums", "gold_error"),
    ("SELECT m FROM nums", "", "gold_error"),
    ("SELECT n FROM nums WHERE n < 0", "SELECT 'none' WHERE 1 = 2", "match"),
    ("SELECT nullif(n, n) FROM nums", "SELECT substr('x', 2) FROM nums", "match"),
    ("SELECT min(n) FROM nums", SLOW, "pred_timeout"),
    (SLOW, "SELECT 1", "gold_error"),
    ("SELECT 1", "SELECT java_method('java.lang.Math', 'abs', -1)", "pred_error"),
    ("SELECT 1", "SELECT * FROM text.`/etc/hostname`", "pred_error"),
    ("SELECT 1", "SELECT 1 WHERE EXISTS (SELECT reflect('java.lang.Math', 'abs', -1))", "pred_error"),
]


def test_execution_match(spark):
    examples = spark.createDataFrame(
        [(i, "nums", gold, pred) for i, (gold, pred, _) in enumerate(CASES)],
        "id bigint, db_id string, gold_sql string, pred_sql string",
    )
    judged = execution_match(examples, timeout=3, use_database=nums)
    got = {r.id: r for r in judged.collect()}
    assert len(got) == len(CASES)
    for i, (_, _, want) in enumerate(CASES):
        assert got[i].status.startswith(want), got[i]
        assert got[i].correct == (want == "match")
        if want == "pred_error: empty":
            assert got[i].status == want
    accuracy = execution_accuracy(judged).first()
    assert (accuracy.n, accuracy.correct, accuracy.execution_accuracy) == (17, 5, 0.2941)


def test_workers_do_not_change_verdicts(spark, rows):
    quick = [(i, "nums", g, p) for i, (g, p, _) in enumerate(CASES) if SLOW not in (g, p)]
    examples = spark.createDataFrame(
        quick, "id bigint, db_id string, gold_sql string, pred_sql string"
    )
    one, four = (
        sorted(rows(execution_match(examples, use_database=nums, workers=n).select("id", "status")))
        for n in (1, 4)
    )
    assert one == four


def test_evaluate_end_to_end(spark):
    examples = spark.createDataFrame(
        [
            (0, "nums", "q0", "SELECT n FROM nums", [("user", "SELECT n FROM nums")]),
            (1, "nums", "q1", "SELECT 1", [("user", "SELECT 2;")]),
            (2, "elsewhere", "q2", "SELECT 1", [("user", "SELECT 1")]),
        ],
        "id bigint, db_id string, question string, gold_sql string, "
        "messages array<struct<role:string,content:string>>",
    )

    def make_generate():
        return lambda batch: [f"```sql\n{m[-1]['content']}\n```" for m in batch]

    predictions, report = evaluate(
        examples, make_generate, 2, use_database=nums, labels={"model": "m", "adapter": None}
    )
    got = {r.id: r for r in predictions.collect()}
    assert got[0].correct and got[0].pred_sql == "SELECT n FROM nums"
    assert got[1].status == "mismatch" and got[1].pred_sql == "SELECT 2"
    assert got[2].status == "gold_error: unknown database elsewhere"
    total = report.first()
    assert (total.model, total.adapter, total.n, total.correct) == ("m", None, 3, 1)
    assert total.status_counts == {"match": 1, "mismatch": 1, "gold_error": 1}
    assert total.execution_accuracy == 0.3333 and total.examples_per_sec > 0


def test_precedence_from_outcome_tables(spark, rows):
    examples = spark.createDataFrame(
        [(1, "x"), (2, " "), (3, "x"), (4, "x"), (5, ""), (6, "x")], "id bigint, pred_sql string"
    )
    outcomes = spark.createDataFrame(
        [
            (1, "gold", "ok", None), (1, "pred", "ok", None),
            (2, "gold", "ok", None),
            (3, "gold", "ok", None), (3, "pred", "timeout", "late"),
            (4, "gold", "ok", None), (4, "pred", "error", "bad: column"),
            (5, "gold", "timeout", "query exceeded 1s"),
            (6, "gold", "ok", None), (6, "pred", "ok", None),
        ],
        "example_id bigint, side string, outcome string, message string",
    )
    results = spark.createDataFrame(
        [(1, "gold", None, ["1"]), (1, "pred", None, ["1"]), (6, "gold", None, ["1"])],
        "example_id bigint, side string, row_no bigint, cells array<string>",
    )
    judged = score_examples(examples, results, outcomes)
    assert dict(rows(judged.select("id", "status"))) == {
        1: "match", 2: "pred_error: empty", 3: "pred_timeout", 4: "pred_error: bad: column",
        5: "gold_error: query exceeded 1s", 6: "mismatch",
    }
    assert dict(rows(status_counts(judged))) == {
        "match": 1, "pred_error": 2, "pred_timeout": 1, "gold_error": 1, "mismatch": 1,
    }
    assert outcomes_by_example(outcomes).count() == 6


def test_accuracy_of_nothing_and_metrics(spark):
    empty = spark.createDataFrame([], "config string, correct boolean, status string")
    assert tuple(execution_accuracy(empty).first()) == (0, 0, 0.0)
    verdicts = spark.createDataFrame(
        [("a", True, "match", 2.0), ("a", False, "pred_error: x", 2.0), ("b", True, "match", 0.0)],
        "config string, correct boolean, status string, secs double",
    )
    nothing = metrics(empty, [], empty["correct"].cast("int")).first()
    assert (nothing.n, nothing.execution_accuracy, nothing.status_counts) == (0, 0.0, {})
    got = {r.config: r for r in metrics(verdicts, ["config"], verdicts["secs"]).collect()}
    assert got["a"].status_counts == {"match": 1, "pred_error": 1}
    assert (got["a"].execution_accuracy, got["a"].examples_per_sec) == (0.5, 1.0)
    assert got["b"].examples_per_sec is None


def test_many_pairs_leave_few_folders_and_no_list(spark, tmp_path, monkeypatch):
    from sqlgauge.plans import runner

    monkeypatch.setattr("sqlgauge.session.shared_dir", lambda session: str(tmp_path))
    examples = spark.range(300).selectExpr(
        "id", "'nums' AS db_id", "'SELECT 1' AS gold_sql",
        "CASE WHEN id % 50 = 0 THEN 'SELECT 2' ELSE ' ' END AS pred_sql",
    )
    results, outcomes = runner.run_pairs(examples, use_database=nums, workers=4)
    assert outcomes.count() == 306 and results.count() == 306
    (made,) = [p for p in (tmp_path / "sqlgauge").iterdir() if p.name.startswith("results-")]
    assert sorted(p.name for p in made.iterdir()) == ["outcomes", "queries", "rows"]
    assert not [p for p in (made / "queries").iterdir() if p.is_dir()]
    with pytest.raises(ValueError):
        runner.run_pairs(examples.union(examples), use_database=nums)


def test_a_statement_runs_once_per_database(spark, monkeypatch):
    from sqlgauge.plans import runner

    run: list[tuple] = []
    original = runner._store

    def counted(session, task, *rest):
        run.append((task["db_id"], task["statement"]))
        return original(session, task, *rest)

    monkeypatch.setattr(runner, "_store", counted)
    gold, ordered = "SELECT n FROM nums", "SELECT n FROM nums ORDER BY n"
    texts = [
        (gold, "SELECT n FROM nums ORDER BY n DESC", "match"),
        (ordered, "SELECT n FROM nums ORDER BY n DESC", "mismatch"),
        (ordered, ordered, "match"),  # the prediction has run as a gold query
        (gold, ordered, "match"),
        ("SELECT bad FROM nums", "SELECT 5", "gold_error"),  # the prediction does not run
        (gold, "SELECT try_reflect('a', 'b')", "pred_error"),  # nor does a refused one
        (gold, " ", "pred_error: empty"),
        (None, gold, "gold_error"),
    ]
    rows = [(10 * c + i, "nums", *pair[:2]) for c in range(5) for i, pair in enumerate(texts)]
    examples = spark.createDataFrame(rows, "id bigint, db_id string, gold_sql string, pred_sql string")
    judged = runner.execution_match(examples, use_database=nums).collect()
    assert len(judged) == 40
    for r in judged:
        assert r.status.startswith(texts[r.id % 10][2]), r
        assert r.gold_rows == (0 if r.id % 10 in (4, 7) else 3)
    assert len(run) == len(set(run)) == 5


@pytest.mark.parametrize(
    "query",
    [
        "SELECT java_method('a', 'b')", "SELECT REFLECT ('a', 'b')", "SELECT `reflect`('a', 'b')",
        "SELECT builtin.Try_Reflect\n('a', 'b')", "SELECT reflect/* /* */ */('a', 'b')",
        "SELECT system.builtin.`java_method` ('a', 'b')", "SELECT reflect -- x\n('a', 'b')",
        "SELECT r'\\', reflect('a', 'b'), '\\'", "SELECT IDENTIFIER('ref' || 'lect')('a', 'b')",
        "SELECT TRANSFORM(n) USING 'cat' FROM nums", "FROM nums MAP n USING /**/ \"cat\" AS m",
    ],
)
def test_statements_that_leave_the_engine_are_refused(spark, query):
    from sqlgauge.plans import runner

    with pytest.raises(QueryError, match="not allowed"):
        runner.read_only(spark, query)
    found = spark.createDataFrame([(query,)], "q string").select(runner.refused(F.col("q")))
    assert found.first()[0]


@pytest.mark.parametrize(
    "query",
    ["SELECT reflect FROM t", "SELECT a.x FROM a JOIN b USING (x)", "SELECT transform(array(1), x -> x)",
     "SELECT my_reflect(1), reflected(2), identifier FROM t", None],
)
def test_statements_that_stay_inside_are_not(spark, query):
    from sqlgauge.plans import runner

    found = spark.createDataFrame([(query,)], "q string").select(runner.refused(F.col("q")))
    assert not found.first()[0]


def test_what_was_not_executed_is_no_match(spark):
    examples = spark.createDataFrame(
        [(1, "SELECT 1"), (2, "SELECT 1"), (3, " ")], "id bigint, pred_sql string"
    )
    outcomes = spark.createDataFrame(
        [(2, "gold", "ok", None), (3, "gold", "ok", None)],
        "example_id bigint, side string, outcome string, message string",
    )
    results = spark.createDataFrame(
        [], "example_id bigint, side string, row_no bigint, cells array<string>"
    )
    got = {r.id: r.status for r in score_examples(examples, results, outcomes).collect()}
    assert got == {
        1: "gold_error: not executed", 2: "pred_error: not executed", 3: "pred_error: empty"
    }
