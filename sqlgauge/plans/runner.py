"""Running generated SQL, read-only and within a time budget, and scoring it.

Each query is a Spark job of its own, started from the driver because its text is
known only there; its rows go from the executors straight to the shared folder and
never through the driver. Comparing and scoring all examples is one job afterwards.
When results exist as tables already, use ``operators.score`` directly.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical_row, positional
from ..functions.prompts import messages_or_default
from ..functions.status import order_matters
from ..functions.text import extract_sql, strip
from ..operators.inference import Generate, complete
from ..operators.joins import join_null_safe
from ..operators.ordering import dense_numbers, in_sequence, number_rows
from ..operators.score import metrics, score_examples
from ..session import delete_path, materialise, new_path

UseDatabase = Callable[[SparkSession, str], None]
SessionOf = Callable[[str], SparkSession]


class QueryError(Exception):
    """The query does not parse, resolve or run."""


class QueryTimeout(Exception):
    """The query ran past its time budget."""


def current_database(session: SparkSession, db_id: str) -> None:
    """Default way to enter a database: by its name in the session catalog."""
    session.catalog.setCurrentDatabase(db_id)


def session_pool(spark: SparkSession, use_database: UseDatabase) -> SessionOf:
    """One session per database, so a database is entered once however many queries run."""
    sessions: dict[str, SparkSession] = {}
    lock = threading.Lock()

    def session_of(db_id: str) -> SparkSession:
        with lock:
            if db_id not in sessions:
                session = spark.newSession()
                use_database(session, db_id)
                sessions[db_id] = session
            return sessions[db_id]

    return session_of


# The functions that call JVM methods, under any qualifier, quoted or not;
# the clause that makes a function name out of a text; and what hands rows to a command.
# A comment may stand wherever white space may. Literals are searched as well: what looks
# like a call inside one is refused rather than trusted to end where it seems to.
REFUSED_PATTERN = (
    r"(?i)\b(?:java_method|reflect|try_reflect|identifier)\b`?\s*(?:\(|/\*|--)"
    r"|\busing\b\s*(?:r?['\"]|/\*|--)"
)
# Fixed value: the message of such a query.
REFUSED_MESSAGE = "calls of JVM methods and commands are not allowed"


def refused(statement: Column) -> Column:
    """Whether a query may not even be analysed, as it could leave the engine."""
    return F.coalesce(F.regexp_like(statement, F.lit(REFUSED_PATTERN)), F.lit(False))


def read_only(session: SparkSession, query: str) -> DataFrame:
    """The query as a DataFrame over the session's tables, and nothing else.

    Wrapped in a SELECT, anything that would write, and any second statement, fails to
    parse. Paths do not count as tables, and calls of JVM methods are refused.
    """
    if re.search(REFUSED_PATTERN, query):
        raise QueryError(REFUSED_MESSAGE)
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    return session.sql(f"SELECT * FROM (\n{query}\n)")


# How long a cancelled query may take to unwind before it is left behind, in seconds.
_GRACE = 30.0


def within_budget(spark: SparkSession, work: Callable[[], None], timeout: float) -> None:
    """Run ``work`` in its own job group and cancel the group after ``timeout`` seconds.

    Only jobs can be cancelled. A query still being planned is waited for a little
    longer and its jobs are then cancelled as they start.
    """
    context = spark.sparkContext
    group = f"query-{uuid.uuid4().hex}"
    failure: list[BaseException] = []

    def run() -> None:
        context.setJobGroup(group, "generated query", interruptOnCancel=True)
        try:
            work()
        except BaseException as error:  # noqa: BLE001 - handed to the caller
            failure.append(error)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(timeout)
    expired = thread.is_alive()
    # Fixed value: the wording of a timeout.
    message = f"query exceeded {timeout}s"
    give_up = time.monotonic() + _GRACE
    while thread.is_alive() and time.monotonic() < give_up:
        context.cancelJobGroup(group)
        thread.join(0.5)
    if thread.is_alive():
        raise QueryTimeout(f"{message} and is still unwinding")
    if expired:
        raise QueryTimeout(message)
    if failure:
        raise QueryError(_first_line(failure[0])) from failure[0]


def _first_line(error: BaseException) -> str:
    text = str(error).strip()
    return text.splitlines()[0] if text else type(error).__name__


def run_query(
    spark: SparkSession,
    db_id: str,
    query: str,
    timeout: float = 30.0,
    use_database: UseDatabase = current_database,
) -> DataFrame:
    """Run one query and return its rows, kept in the shared folder, in their order.

    Raises QueryError or QueryTimeout.
    """
    rows: list[DataFrame] = []

    def work() -> None:
        session = session_pool(spark, use_database)(db_id)
        rows.append(materialise(in_sequence(positional(read_only(session, query))), "query"))

    within_budget(spark, work, timeout)
    return rows[0].orderBy("_seq").drop("_seq")


def _store(
    spark: SparkSession,
    run: dict,
    folder: str,
    timeout: float,
    session_of: SessionOf,
    digits: int | None,
) -> tuple[int, str, str | None]:
    """Run one statement, write its canonical rows and report the outcome."""

    def work() -> None:
        rows = positional(read_only(session_of(run["db_id"]), run["statement"]))
        in_sequence(rows.select(canonical_row(rows, digits).alias("cells"))).select(
            F.lit(run["run_id"]).cast("bigint").alias("run_id"), "_seq", "cells"
        ).write.parquet(f"{folder}/{run['run_id']}")

    try:
        within_budget(spark, work, timeout)
    except QueryTimeout as error:
        return run["run_id"], "timeout", str(error)
    except QueryError as error:
        return run["run_id"], "error", str(error)
    return run["run_id"], "ok", None


_RUN_TYPE = "run_id bigint, outcome string, message string"
_STORED_TYPE = "run_id bigint, _seq bigint, cells array<string>"
# Runs whose results are put into one table together.
_STRETCH = 256


def _run_all(
    runs: DataFrame,
    root: str,
    name: str,
    workers: int | None,
    store: Callable[[dict, str], tuple[int, str, str | None]],
) -> None:
    """Run each row of ``runs`` once; append outcomes and results to the tables of ``root``.

    Only the statements visit the driver, a stretch of 256 at a time, and of the refused
    ones not even those. The next stretch starts while the last queries of the one before
    still run; once they have ended their folders become one table and go.
    """
    spark = runs.sparkSession

    def settle(folder: str, futures: list[Future]) -> None:
        outcomes = [future.result() for future in futures]
        spark.createDataFrame(outcomes, _RUN_TYPE).coalesce(1).write.mode("append").parquet(
            f"{root}/outcomes"
        )
        if any(outcome[1] == "ok" for outcome in outcomes):
            stored = spark.read.schema(_STORED_TYPE).parquet(f"{folder}/*")
            stored.write.mode("append").parquet(f"{root}/rows")
        delete_path(spark, folder)

    runs.where("refused").select(
        "run_id", F.lit("error").alias("outcome"), F.lit(REFUSED_MESSAGE).alias("message")
    ).write.mode("append").parquet(f"{root}/outcomes")
    texts = runs.where("NOT refused").select("run_id", "db_id", "statement")
    slots = workers or max(1, spark.sparkContext.defaultParallelism // 4)
    waiting: tuple[str, list[Future]] | None = None
    with ThreadPoolExecutor(max_workers=slots) as pool:
        for number, stretch in enumerate(_stretches(texts.toLocalIterator(), _STRETCH)):
            folder = f"{root}/queries/{name}-{number}"
            futures = [pool.submit(store, run, folder) for run in stretch]
            if waiting:
                settle(*waiting)
            waiting = (folder, futures)
        if waiting:
            settle(*waiting)


def _distinct_runs(sides: DataFrame, first: int) -> DataFrame:
    """The distinct statements per database, numbered from ``first``, and stored."""
    texts = number_rows(sides.select("db_id", "statement").distinct(), None, name="_no")
    return materialise(
        texts.select(
            (F.col("_no") + first).alias("run_id"),
            "db_id",
            "statement",
            refused(F.col("statement")).alias("refused"),
        ),
        "runs",
    )


def run_pairs(
    examples: DataFrame,
    timeout: float = 30.0,
    use_database: UseDatabase = current_database,
    workers: int | None = None,
    digits: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Run gold and predicted queries; returns results and outcomes (runs many jobs).

    ``examples`` is ``(id, db_id, gold_sql, pred_sql)`` with unique ids; a repeated one is
    a ValueError. A statement runs once per database, however many examples and sides
    share it: the gold queries first, then the predictions that are not blank, whose gold
    query succeeded and whose text has not run yet. Outcomes and results are joined back
    to the examples afterwards. Statements that ``refused`` finds are errors and never
    reach the driver.

    ``workers`` queries run side by side, by default a quarter of the cluster's task slots;
    their budgets then include waiting for free slots, so give the session
    ``spark.scheduler.mode=FAIR`` when some of them are heavy.
    """
    spark = examples.sparkSession
    root = new_path(spark, "results")
    session_of = session_pool(spark, use_database)
    if not examples.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("example ids must be unique")
    rows = examples.select(
        F.col("id").alias("example_id"),
        "db_id",
        F.coalesce("gold_sql", F.lit("")).alias("gold"),
        F.coalesce("pred_sql", F.lit("")).alias("pred"),
        F.coalesce(order_matters(F.col("gold_sql")), F.lit(False)).alias("ordered"),
    )

    def store(run: dict, folder: str) -> tuple[int, str, str | None]:
        return _store(spark, run, folder, timeout, session_of, digits)

    spark.createDataFrame([], _RUN_TYPE).write.parquet(f"{root}/outcomes")
    spark.createDataFrame([], _STORED_TYPE).write.parquet(f"{root}/rows")
    key = ["db_id", "statement"]
    gold = rows.select("example_id", "ordered", "db_id", F.col("gold").alias("statement"), "pred")
    gold_runs = _distinct_runs(gold, 0)
    _run_all(gold_runs, root, "gold", workers, store)
    linked = materialise(
        join_null_safe(gold, gold_runs.drop("refused"), key).select(
            "example_id", "ordered", "db_id", "run_id", "pred"
        ),
        "gold-runs",
    )
    succeeded = spark.read.schema(_RUN_TYPE).parquet(f"{root}/outcomes").where("outcome = 'ok'")
    pred = (
        linked.where(strip(F.col("pred")) != "")
        .join(succeeded.select("run_id"), "run_id", "left_semi")
        .select("example_id", "ordered", "db_id", F.col("pred").alias("statement"))
    )
    pred_runs = _distinct_runs(
        join_null_safe(pred.select(*key).distinct(), gold_runs.select(*key), key, "left_anti"),
        gold_runs.count(),
    )
    _run_all(pred_runs, root, "pred", workers, store)
    every_run = gold_runs.unionByName(pred_runs).drop("refused")
    side = ["example_id", "ordered", "run_id"]
    uses = materialise(
        linked.select(*side, F.lit("gold").alias("side")).unionByName(
            join_null_safe(pred, every_run, key).select(*side, F.lit("pred").alias("side"))
        ),
        "uses",
    )
    outcomes = spark.read.schema(_RUN_TYPE).parquet(f"{root}/outcomes")
    stored = spark.read.schema(_STORED_TYPE).parquet(f"{root}/rows")
    return long_results(uses, stored), uses.join(outcomes, "run_id").select(
        "example_id", "side", "outcome", "message"
    )


def long_results(uses: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored results in long form, with dense positions where order counts."""
    plain = uses.where("NOT ordered").join(stored, "run_id").select(
        "example_id", "side", F.lit(None).cast("bigint").alias("row_no"), "cells"
    )
    by_order = uses.where("ordered")
    needed = stored.join(by_order.select("run_id").distinct(), "run_id", "left_semi")
    numbered = dense_numbers(needed, ["run_id"], "row_no")
    ordered = by_order.join(numbered, "run_id")
    return plain.unionByName(ordered.select("example_id", "side", "row_no", "cells"))


def _stretches(rows: Iterable, size: int) -> Iterable[list[dict]]:
    stretch = []
    for row in rows:
        stretch.append(row.asDict())
        if len(stretch) == size:
            yield stretch
            stretch = []
    if stretch:
        yield stretch


def execution_match(
    examples: DataFrame,
    timeout: float = 30.0,
    use_database: UseDatabase = current_database,
    workers: int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Examples with ``correct`` and ``status`` after running both queries of each."""
    results, outcomes = run_pairs(examples, timeout, use_database, workers, digits)
    return score_examples(examples, results, outcomes)


def evaluate(
    examples: DataFrame,
    make_generate: Callable[[], Generate],
    batch_size: int = 8,
    timeout: float = 30.0,
    use_database: UseDatabase = current_database,
    workers: int | None = None,
    labels: dict[str, str | None] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Predictions of a model on prepared examples, and the accuracy report (runs jobs).

    Missing or empty messages are built from schema and question, where those are there.

    The completions are written to the shared folder before any query runs, so the
    model is asked once per example; the time that takes is the generation time of
    the report. ``labels`` (model, adapter, backend) become columns of the report.
    """
    if {"messages", "schema", "question"} <= set(examples.columns):
        rebuilt = messages_or_default(F.col("messages"), F.col("schema"), F.col("question"))
        examples = examples.withColumn("messages", rebuilt)
    asked = complete(examples, make_generate, batch_size)
    began = time.perf_counter()
    predicted = materialise(
        asked.withColumn("pred_sql", extract_sql(F.col("raw"))), "predictions"
    )
    seconds = time.perf_counter() - began
    judged = materialise(execution_match(predicted, timeout, use_database, workers), "verdicts")
    report = metrics(judged, [], F.lit(seconds))
    for name, text in (labels or {}).items():
        report = report.withColumn(name, F.lit(text).cast("string"))
    predictions = judged.select(
        "id", "db_id", "question", "gold_sql", "pred_sql", "raw", "correct", "status"
    )
    return predictions, report
