"""Comparing results and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical_cell
from ..functions.status import order_matters, status_family
from ..operators import compare as C
from ..operators import score as S
from ..operators.ordering import number_rows
from ..plans.runner import execution_match
from ..session import new_path
from ..sources.reports import write_json_lines
from .base import query, sql_round, table

# A predicted result that differs from the gold one in rare line items.
_PRED_DISCOUNT = (
    "CASE WHEN l_quantity = 1 AND l_discount = 0.1 AND l_tax = 0 THEN 0.11 ELSE l_discount END"
)
_SIDES_SQL = f"""
sides AS (
  SELECT l_suppkey AS example_id, 1 AS gold, 0 AS pred, l_quantity AS q, l_returnflag AS f, l_discount AS d
  FROM lineitem
  UNION ALL
  SELECT l_suppkey, 0, 1, l_quantity, l_returnflag, {_PRED_DISCOUNT} FROM lineitem
),
balance AS (
  SELECT example_id, q, f, d, sum(gold)::BIGINT AS gold_count, sum(pred)::BIGINT AS pred_count
  FROM sides GROUP BY ALL
)
"""


def _supplier_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of each supplier; the prediction returns quantities as integers."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_quantity", "l_discount",
        F.col("l_quantity").cast("int").alias("pred_quantity"),
        F.expr(_PRED_DISCOUNT).cast("double").alias("pred_discount"),
    )
    return C.long_form_pairs(
        lines,
        F.col("l_suppkey"),
        _cells(lines, "l_quantity", "l_returnflag", "l_discount"),
        _cells(lines, "pred_quantity", "l_returnflag", "pred_discount"),
    )


def _cells(rows: DataFrame, *names: str) -> Column:
    """Canonical cells of the columns named."""
    return F.array(*[canonical_cell(name, rows.schema[name].dataType) for name in names])


@query(f"""
WITH {_SIDES_SQL}
SELECT example_id, bool_and(gold_count = pred_count) AS results_equal,
  sum(gold_count)::BIGINT AS gold_rows, sum(pred_count)::BIGINT AS pred_rows
FROM balance GROUP BY example_id
""")
def match_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are the results of each example equal as multisets?"""
    return C.compare_results(_supplier_results(spark, sf_dir))


@query(f"""
WITH {_SIDES_SQL}
SELECT example_id, CAST(CAST(q AS BIGINT) AS VARCHAR) AS c0, f AS c1,
  CASE WHEN d = 0 THEN '0' ELSE CAST(CAST(d AS DOUBLE) AS VARCHAR) END AS c2, gold_count, pred_count
FROM balance WHERE gold_count <> pred_count
""")
def mismatch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that make results differ."""
    rows = C.mismatch_rows(_supplier_results(spark, sf_dir))
    return rows.select(
        "example_id", *[F.col("cells")[i].alias(f"c{i}") for i in range(3)],
        "gold_count", "pred_count",
    )


@query("""
WITH ranked AS (
  SELECT o_custkey AS example_id, o_orderkey,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS gold_no,
    row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 1000) DESC, o_orderkey) AS pred_no
  FROM orders
)
SELECT example_id, bool_and(gold_no = pred_no) AS results_equal,
  count(*) AS gold_rows, count(*) AS pred_rows
FROM ranked GROUP BY example_id
""")
def match_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are the results of each example equal row by row? Gold sorts by price, the
    prediction by thousands."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    orders = orders.withColumn("thousands", F.floor(F.col("o_totalprice") / 1000))
    sides = []
    for side, price in (("gold", "o_totalprice"), ("pred", "thousands")):
        numbered = number_rows(
            orders.select("o_custkey", "o_orderkey", price),
            [F.desc(price), "o_orderkey"],
            ["o_custkey"],
        )
        cells = F.array(F.col("o_orderkey").cast("string"))
        sides.append(C.long_form(numbered, F.col("o_custkey"), side, cells, F.col("row_no")))
    return C.compare_results(sides[0].unionByName(sides[1]))


@query("""
WITH gold AS (
  SELECT n_name, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue, count(*) AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY n_name
)
SELECT true AS results_equal, count(*) AS gold_rows, count(*) AS pred_rows FROM gold
""")
def match_two_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to add up revenue per nation, the second adding up per supplier first."""
    lines = table(spark, sf_dir, "lineitem").withColumn(
        "price", F.col("l_extendedprice").cast("decimal(18,2)")
    )
    suppliers = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    on_supplier = F.col("l_suppkey") == F.col("s_suppkey")
    gold = lines.join(suppliers, on_supplier).groupBy("n_name").agg(F.sum("price"), F.count("*"))
    per_supplier = lines.groupBy("l_suppkey").agg(
        F.sum("price").alias("price"), F.count("*").alias("n")
    )
    pred = per_supplier.join(suppliers, on_supplier).groupBy("n_name").agg(
        F.sum("price"), F.sum("n").cast("double")
    )
    return C.results_match(gold.orderBy("n_name"), pred.orderBy("n_name"), True)


_EXAMPLES = """
  o_orderkey AS id,
  o_orderpriority AS config,
  CASE o_orderstatus WHEN 'F' THEN 'SELECT l FROM t Order By n' ELSE 'SELECT l FROM t' END AS gold_sql,
  CASE WHEN o_totalprice < 20000 THEN '  ' ELSE 'SELECT l' END AS pred_sql,
  CASE WHEN o_totalprice > 480000 THEN 'error' WHEN o_totalprice > 470000 THEN 'timeout' WHEN o_totalprice > 440000 THEN NULL ELSE 'ok' END AS gold_outcome,
  CASE WHEN o_totalprice > 480000 THEN 'no such table: x' WHEN o_totalprice > 470000 THEN 'query exceeded 30.0s' END AS gold_message,
  CASE WHEN o_totalprice < 100000 THEN 'ok' WHEN o_totalprice < 110000 THEN 'timeout' WHEN o_totalprice < 130000 THEN 'error' WHEN o_totalprice < 140000 THEN NULL ELSE 'ok' END AS pred_outcome,
  CASE WHEN o_totalprice < 100000 THEN NULL WHEN o_totalprice < 130000 THEN 'no such column: y' END AS pred_message
"""
_PRED_QUANTITY = "CASE WHEN l_tax = 0.08 AND l_discount = 0.1 THEN l_quantity + 0.5 ELSE l_quantity END"
_PRED_LINE = "CASE WHEN config = '1-URGENT' THEN 8 - l_linenumber ELSE l_linenumber END"
_SCORED_SQL = f"""
examples AS (SELECT {_EXAMPLES} FROM orders),
lines AS (
  SELECT id, contains(lower(gold_sql), 'order by') AS ordered, l_linenumber, {_PRED_LINE} AS pred_line,
    l_partkey, l_quantity, {_PRED_QUANTITY} AS pred_quantity
  FROM lineitem JOIN examples ON l_orderkey = id
),
sides AS (
  SELECT id, CASE WHEN ordered THEN l_linenumber END AS row_no, l_partkey, l_quantity AS q, 1 AS gold, 0 AS pred FROM lines
  UNION ALL
  SELECT id, CASE WHEN ordered THEN pred_line END, l_partkey, pred_quantity, 0, 1 FROM lines
),
balance AS (
  SELECT id, row_no, l_partkey, q, sum(gold)::BIGINT AS g, sum(pred)::BIGINT AS p FROM sides GROUP BY ALL
),
compared AS (
  SELECT id, bool_and(g = p) AS equal, sum(g)::BIGINT AS gold_rows, sum(p)::BIGINT AS pred_rows
  FROM balance GROUP BY id
),
judged AS (
  SELECT id, config,
    CASE WHEN gold_outcome IS NULL THEN 'gold_error: not executed'
         WHEN gold_outcome <> 'ok' THEN 'gold_error: ' || gold_message
         WHEN trim(pred_sql) = '' THEN 'pred_error: empty'
         WHEN pred_outcome IS NULL THEN 'pred_error: not executed'
         WHEN pred_outcome = 'timeout' THEN 'pred_timeout'
         WHEN pred_outcome = 'error' THEN 'pred_error: ' || pred_message
         WHEN coalesce(equal, true) THEN 'match' ELSE 'mismatch' END AS status,
    coalesce(gold_rows, 0) AS gold_rows, coalesce(pred_rows, 0) AS pred_rows
  FROM examples LEFT JOIN compared USING (id)
)
"""


def _columns(text: str) -> list[str]:
    return [line.strip().rstrip(",") for line in text.strip().splitlines()]


# Orders and line items that one task compares and judges, in some 350 MB.
_ROWS_PER_TASK = 250_000


def _task_count(*tables: DataFrame) -> int:
    """As many tasks as the rows of the tables call for (counts them), but one per core at least."""
    rows = sum(rows.count() for rows in tables)
    cores = tables[0].sparkSession.sparkContext.defaultParallelism
    return max(cores, -(-rows // _ROWS_PER_TASK))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as examples, their line items as results, outcomes by price.

    Both tables are dealt out by order before anything is joined, and the comparison and the
    joins of the verdicts keep to that. The parts grow in number with the tables, not in size;
    what the planner chooses goes by compressed bytes, many times less than a task holds.
    """
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    tasks = _task_count(orders, items)
    judged = orders.selectExpr(*_columns(_EXAMPLES)).repartition(tasks, "id")
    examples = judged.select("id", "config", "gold_sql", "pred_sql")
    outcomes = judged.select(
        F.col("id").alias("example_id"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(side).alias("side"),
                        F.col(f"{side}_outcome").alias("outcome"),
                        F.col(f"{side}_message").alias("message"),
                    )
                    for side in ("gold", "pred")
                ]
            )
        ),
    ).where("outcome IS NOT NULL")
    flags = examples.select("id", "config", order_matters(F.col("gold_sql")).alias("ordered"))
    lines = items.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax"
    ).repartition(tasks, "l_orderkey")
    rows = lines.join(flags, F.col("l_orderkey") == F.col("id")).select(
        "id", "ordered", "l_linenumber", "l_partkey", "l_quantity",
        F.expr(_PRED_LINE).alias("pred_line"),
        F.expr(_PRED_QUANTITY).cast("double").alias("pred_quantity"),
    )
    results = C.long_form_pairs(
        rows,
        F.col("id"),
        _cells(rows, "l_partkey", "l_quantity"),
        _cells(rows, "l_partkey", "pred_quantity"),
        F.when(F.col("ordered"), F.col("l_linenumber")),
        F.when(F.col("ordered"), F.col("pred_line")),
    )
    return S.score_examples(examples, results, outcomes)


@query(f"""
WITH {_SCORED_SQL}
SELECT id, config, status = 'match' AS correct, status, gold_rows, pred_rows FROM judged
""")
def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status for every example."""
    return _scored(spark, sf_dir).select(
        "id", "config", "correct", "status", "gold_rows", "pred_rows"
    )


@query(f"""
WITH {_SCORED_SQL}
SELECT id, config AS db_id, gold_sql, pred_sql, status = 'match' AS correct, status
FROM judged JOIN (SELECT id, gold_sql, pred_sql FROM examples) USING (id)
""")
def predictions_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged predictions written as JSON lines and read back with declared types."""
    path = new_path(spark, "predictions")
    judged = _scored(spark, sf_dir).withColumnRenamed("config", "db_id")
    columns = ["id", "db_id", "gold_sql", "pred_sql", "correct", "status"]
    write_json_lines(judged.select(*columns), path)
    schema = judged.select(*columns).schema
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


@query(f"""
WITH {_SCORED_SQL},
totals AS (
  SELECT config, count(*) AS n, count(*) FILTER (WHERE status = 'match') AS correct,
    CAST(7.125 * length(config) AS DOUBLE) AS seconds
  FROM judged GROUP BY config
)
SELECT config, n, correct,
  {sql_round('correct::DOUBLE / n::DOUBLE', 4)} AS execution_accuracy,
  {sql_round('n::DOUBLE / seconds', 3)} AS examples_per_sec,
  {sql_round('seconds', 2)} AS gen_seconds
FROM totals
""")
def accuracy_by_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution accuracy and generation speed per configuration."""
    seconds = F.length("config") * F.lit(7.125)
    return S.execution_accuracy(_scored(spark, sf_dir), ["config"], seconds)


@query(f"""
WITH {_SCORED_SQL}
SELECT config, split_part(status, ':', 1) AS status, count(*) AS n FROM judged GROUP BY ALL
""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status histogram per configuration."""
    return S.status_counts(_scored(spark, sf_dir), ["config"])


# Queries that run in both engines: gold, prediction.
PAIRS = [
    (
        "SELECT n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
        "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) FROM nation "
        "WHERE n_nationkey IN (SELECT c_nationkey FROM customer)",
    ),
    (
        "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 ORDER BY o_totalprice, o_orderkey",
        "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 ORDER BY o_totalprice DESC, o_orderkey",
    ),
    (
        "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000",
        "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 ORDER BY o_totalprice DESC",
    ),
    (
        "SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey",
        "SELECT k, CAST(n AS DOUBLE) FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) t "
        "ORDER BY n DESC, k -- same",
    ),
    (
        "SELECT l_returnflag, sum(l_linenumber) FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, sum(l_linenumber) FROM lineitem WHERE l_quantity > 1 GROUP BY l_returnflag",
    ),
    ("SELECT count(*) FROM orders", "SELECT count(* FROM orders"),
    ("SELECT count(*) FROM orders", " "),
    ("SELECT no_such_column FROM orders", "SELECT count(*) FROM orders"),
    ("SELECT count(*) FROM orders", "INSERT INTO region VALUES (9, 'X')"),
    (
        "SELECT count(*) FROM orders",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
    ),
    ("SELECT count(*) FROM orders", "SELECT count(*) FROM text.`/etc/hostname`"),
]
_FAILED = {i: "gold_error" if i == 7 else "pred_error" for i in range(5, len(PAIRS))}


def _pair_sql(number: int) -> str:
    gold, pred = PAIRS[number]
    ordered = "order by" in gold.lower()
    if number == 7:
        return "SELECT 7 AS id, 'gold_error' AS status, false AS correct, 0 AS gold_rows, 0 AS pred_rows"
    gold_rows = f"(SELECT count(*) FROM ({gold}\n))"
    if number in _FAILED:
        return (
            f"SELECT {number} AS id, '{_FAILED[number]}' AS status, false AS correct, "
            f"{gold_rows} AS gold_rows, 0 AS pred_rows"
        )
    position = ", row_number() OVER () AS p" if ordered else ""
    a, b = (f"SELECT *{position} FROM ({text}\n) t" for text in (gold, pred))
    difference = f"(SELECT count(*) FROM (({a}) EXCEPT ALL ({b})))"
    reverse = f"(SELECT count(*) FROM (({b}) EXCEPT ALL ({a})))"
    equal = f"({difference} + {reverse} = 0)"
    return (
        f"SELECT {number} AS id, CASE WHEN {equal} THEN 'match' ELSE 'mismatch' END AS status, "
        f"{equal} AS correct, {gold_rows} AS gold_rows, (SELECT count(*) FROM ({pred}\n)) AS pred_rows"
    )


@query("\nUNION ALL\n".join(_pair_sql(i) for i in range(len(PAIRS))))
def run_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL texts run read-only against the tables, compared and judged."""

    def use_tables(session: SparkSession, db_id: str) -> None:
        for name in ("customer", "nation", "orders", "lineitem", "region"):
            table(session, db_id, name).createOrReplaceTempView(name)

    examples = spark.createDataFrame(
        [(i, sf_dir, gold, pred) for i, (gold, pred) in enumerate(PAIRS)],
        "id bigint, db_id string, gold_sql string, pred_sql string",
    )
    judged = execution_match(examples, 600.0, use_tables, workers=4)
    return judged.select(
        "id", status_family(F.col("status")).alias("status"), "correct", "gold_rows", "pred_rows"
    )
