"""Prompts, extraction, catalogs and preparation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import (
    MESSAGES_TYPE, SYSTEM_PROMPT, append_answer, build_messages,
    messages_or_default, parse_response, request_body, user_prompt,
)
from ..functions.text import decode_utf8, extract_sql
from ..operators.inference import attach_completions
from ..plans.prepare import prepare_examples as prepare
from ..plans.prepare import skip_counts
from ..operators.ordering import number_rows
from ..session import new_path
from ..sources.catalog import read_catalog, schema_texts
from ..sources.examples import read_examples, read_raw_split
from ..sources.reports import write_json_lines
from .base import SQL_ASK, TEMPLATE, query, sql_strip, sql_text, sql_turns, table

_SYSTEM = sql_text(SYSTEM_PROMPT)


def sql_prompt(schema: str, question: str, knowledge: str = "''") -> str:
    return (
        f"'Database schema:' || chr(10) || {sql_strip(schema)} || chr(10) || chr(10) || {knowledge}"
        f" || 'Question: ' || {sql_strip(question)} || chr(10) || chr(10) || 'SQL:'"
    )


_EVIDENCE = "CASE lang WHEN 'en' THEN NULL WHEN 'fr' THEN '' WHEN 'de' THEN '  ' ELSE ' language ' || lang || ' ' END"


@query(f"""
SELECT doc_id, {sql_prompt(
    "'  CREATE TABLE ' || source || ' (doc INT);  '", "text",
    f"CASE WHEN {_EVIDENCE} <> '' THEN 'Knowledge: ' || {sql_strip(_EVIDENCE)} || chr(10) || chr(10) ELSE '' END",
)} AS prompt FROM documents
""")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User prompts with and without a knowledge line."""
    schema = F.concat(F.lit("  CREATE TABLE "), F.col("source"), F.lit(" (doc INT);  "))
    return table(spark, sf_dir, "documents").select(
        "doc_id", user_prompt(schema, F.col("text"), F.expr(_EVIDENCE)).alias("prompt")
    )


@query(f"""
SELECT conv_id, turn, 0 AS position, 'system' AS role, {_SYSTEM} AS content
FROM conversations WHERE role <> 'user'
UNION ALL
SELECT conv_id, turn, 1, 'user', {sql_prompt("'CREATE TABLE c_' || conv_id", "text")}
FROM conversations WHERE role <> 'user'
UNION ALL
SELECT conv_id, turn, 0, role, text FROM conversations WHERE role = 'user'
""")
def messages_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored messages; missing for one role and empty for another, hence rebuilt."""
    stored = F.when(
        F.col("role") == "user", F.array(F.struct("role", F.col("text").alias("content")))
    ).when(F.col("role") == "assistant", F.from_json(F.lit("[]"), MESSAGES_TYPE))
    schema = F.concat(F.lit("CREATE TABLE c_"), F.col("conv_id").cast("string"))
    chat = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", messages_or_default(stored, schema, F.col("text")).alias("messages")
    )
    return chat.select(
        "conv_id", "turn", F.posexplode("messages").alias("position", "message")
    ).select("conv_id", "turn", "position", "message.role", "message.content")


# Wrapping of texts into completions, as SQL both engines understand.
_COMPLETION = """
CASE
  WHEN lang = 'en' AND n_chars > 4000 THEN '```sql' || chr(10) || 'SQL: ' || text || ';' || chr(10) || 'Done.' || chr(10) || '```'
  WHEN lang = 'en' AND n_chars > 2000 THEN 'Here it is:' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || 'and ```more```;'
  WHEN lang = 'en' AND n_chars > 1000 THEN 'Query :  ' || text || '; -- note'
  WHEN lang = 'en' THEN chr(12288) || ' sqlite:' || chr(9) || text || chr(160)
  WHEN lang = 'fr' THEN '``````' || text
  WHEN lang = 'de' THEN '```SQLite' || chr(10) || text || '```'
  WHEN n_chars > 1000 THEN '```sql' || chr(10) || text
  ELSE text
END
"""
# White space, spelled out for an engine whose classes know ASCII only.
_WS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# chr() of the second engine gives code points, of the first only bytes.
_SPARK_COMPLETION = _COMPLETION.replace("chr(12288)", "'\\u3000'").replace("chr(160)", "'\\u00a0'")


def sql_extraction(source: str, key: str, completion: str) -> str:
    """Extraction by regular expressions, for the second engine."""
    fence = f"'(?is)```(?:sql)?{_WS}*(.*?)```'"
    label = f"'(?i)\\A{_WS}*(?:sql|sqlite|query){_WS}*:{_WS}*'"
    found = f"CASE WHEN regexp_matches(t, {fence}) THEN regexp_extract(t, {fence}, 1) ELSE t END"
    return f"""
WITH wrapped AS (SELECT {key}, {sql_strip(completion)} AS t FROM {source}),
body AS (SELECT {key}, {sql_strip(found)} AS t FROM wrapped),
bare AS (SELECT {key}, regexp_replace(t, {label}, '') AS t FROM body)
SELECT {key}, trim(regexp_replace(split_part(t, ';', 1), '{_WS}+', ' ', 'g')) AS pred_sql FROM bare
"""


@query(sql_extraction("documents", "doc_id", _COMPLETION))
def extract_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement inside fenced, labelled, commented and plain completions."""
    docs = table(spark, sf_dir, "documents").withColumn("raw", F.expr(_SPARK_COMPLETION))
    return docs.select("doc_id", extract_sql(F.col("raw")).alias("pred_sql"))


_CATALOG_ROWS = """
  CAST(l_orderkey AS STRING) AS db_id,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'index' ELSE 'table' END AS type,
  CASE WHEN l_quantity = 50 THEN 'SQLite_' ELSE 'line_' END || l_linenumber AS table_name,
  CASE WHEN l_tax < 0.08 THEN '  CREATE TABLE p_' || l_partkey || ' (a INT) ;; ;' END AS ddl
"""


@query(f"""
WITH catalog AS (SELECT {_CATALOG_ROWS} FROM lineitem)
SELECT db_id,
  string_agg(rtrim({sql_strip('ddl')}, ';'), ';' || chr(10) || chr(10)
             ORDER BY table_name, rtrim({sql_strip('ddl')}, ';')) || ';' AS schema
FROM catalog
WHERE type = 'table' AND ddl IS NOT NULL AND NOT (lower(table_name) LIKE 'sqlite_%')
GROUP BY db_id
""")
def schema_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema texts of one database per order, one table per line item."""
    lines = table(spark, sf_dir, "lineitem")
    return schema_texts(lines.selectExpr(*_split_columns(_CATALOG_ROWS)))


def _split_columns(columns: str) -> list[str]:
    return [line.strip().rstrip(",") for line in columns.strip().splitlines()]


@query("""
SELECT s_name AS db_id,
  'CREATE TABLE accounts (n INT, "' || s_name || '" TEXT);' || chr(10) || chr(10)
  || 'CREATE TABLE stock_' || s_nationkey || ' (id INTEGER PRIMARY KEY AUTOINCREMENT);' AS schema
FROM supplier
""")
def catalog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema texts read out of schema dumps, files of JSON lines with many suppliers each."""
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "s_name AS db_id",
        "'CREATE TABLE stock_' || s_nationkey || ' (id INTEGER PRIMARY KEY AUTOINCREMENT)' AS stock",
        """'CREATE TABLE accounts (n INT, "' || s_name || '" TEXT)' AS accounts""",
        "'stock_' || s_nationkey AS stock_name",
    )
    objects = suppliers.selectExpr(
        "db_id",
        "stack(4, 'table', stock_name, stock, 'table', 'accounts', accounts,"
        " 'table', 'sqlite_sequence', 'CREATE TABLE sqlite_sequence(name,seq)',"
        " 'index', 'by_n', 'CREATE INDEX by_n ON accounts(n)') AS (type, table_name, ddl)",
    )
    path = new_path(spark, "catalogs")
    write_json_lines(objects, path)
    return schema_texts(read_catalog(spark, path))


# Broken bytes around a text, as hexadecimal digits: cut characters, bytes that never
# occur, an encoded surrogate, an overlong form and a genuine replacement character.
_BROKEN = {
    0: ("E282", "C3"),
    1: ("EFBFBD", "EDA080"),
    2: ("F09F98", "F0808080EFBFBD"),
    3: ("FF41FE", "C0AF42F4908080"),
    4: ("80BF", "E28241F0904142"),
}
_HEX_CHARACTER = (
    "(?:[0-7][0-9A-F])+|(?:C[2-9A-F]|D[0-9A-F])[89AB][0-9A-F]|E0[AB][0-9A-F][89AB][0-9A-F]"
    "|E[1-9A-CEF](?:[89AB][0-9A-F]){2}|ED[89][0-9A-F][89AB][0-9A-F]"
    "|F0[9AB][0-9A-F](?:[89AB][0-9A-F]){2}|F[1-3](?:[89AB][0-9A-F]){3}|F48[0-9A-F](?:[89AB][0-9A-F]){2}"
)


def _broken_case(side: int, prefix: str = "", suffix: str = "") -> str:
    cases = " ".join(
        f"WHEN {k} THEN {prefix}'{parts[side]}'{suffix}" for k, parts in _BROKEN.items()
    )
    return f"CASE doc_id % 5 {cases} END"


# The text without its first byte, which may have been the first of several.
@query(f"""
WITH broken AS (
  SELECT doc_id, {_broken_case(0)} || substr(hex(encode(text)), 3) || {_broken_case(1)} AS bytes
  FROM documents
), mended AS (
  SELECT doc_id, bytes, regexp_replace(bytes, '({_HEX_CHARACTER})|..', '\\1', 'g') AS kept FROM broken
)
SELECT doc_id, decode(unhex(kept)) AS text, (length(bytes) - length(kept)) // 2 AS dropped FROM mended
""")
def broken_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts between and behind bytes that are no UTF-8, which decoding drops."""
    data = F.concat(
        F.expr(_broken_case(0, "unhex(", ")")),
        F.expr("substring(CAST(text AS BINARY), 2)"),
        F.expr(_broken_case(1, "unhex(", ")")),
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", data.alias("data"))
    text = decode_utf8(F.col("data"))
    return rows.select(
        "doc_id",
        text.alias("text"),
        (F.octet_length("data") - F.octet_length(text)).cast("long").alias("dropped"),
    )


_RAW_ROWS = """
  CASE WHEN o_orderdate < '2000-01-01' THEN 'train' ELSE 'dev' END AS split,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS file_no,
  o_orderkey AS pos,
  CAST(o_custkey AS STRING) AS db_id,
  ' What did order ' || o_orderkey || ' of priority ' || o_orderpriority || ' cost? ' AS question,
  'SELECT ' || o_orderkey AS gold_sql
"""
_ACCOUNT = "'CREATE TABLE account (nation_' || c_nationkey || ' INT);'"
_SEGMENT = "'CREATE TABLE segment (' || lower(c_mktsegment) || ' TEXT)'"
_PREPARED_SQL = f"""
raw AS (SELECT {_RAW_ROWS} FROM orders),
schemas AS (
  SELECT CAST(c_custkey AS STRING) AS db_id,
    rtrim({_ACCOUNT}, ';') || ';' || chr(10) || chr(10) || {_SEGMENT} || ';' AS schema
  FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY'
)
"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_split_columns(_RAW_ROWS))


def _customer_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables per customer; none for those in debt, no DDL for one segment."""
    readable = F.col("c_mktsegment") != "MACHINERY"
    tables = F.array(
        F.struct(F.lit("segment").alias("table_name"), F.expr(_SEGMENT).alias("ddl")),
        F.struct(F.lit("account").alias("table_name"), F.expr(_ACCOUNT).alias("ddl")),
    )
    return (
        table(spark, sf_dir, "customer")
        .where("c_acctbal >= 0")
        .select(
            F.col("c_custkey").cast("string").alias("db_id"),
            readable.alias("readable"),
            F.explode(tables).alias("t"),
        )
        .select(
            "db_id",
            F.lit("table").alias("type"),
            "t.table_name",
            F.when(F.col("readable"), F.col("t.ddl")).alias("ddl"),
        )
    )


@query(f"""
WITH {_PREPARED_SQL}
SELECT split,
  row_number() OVER (PARTITION BY split ORDER BY file_no, pos) - 1 AS id,
  db_id, '/data/database/' || db_id || '/' || db_id || '.sqlite' AS db_path,
  question, gold_sql, schema, {_SYSTEM} AS system_turn,
  {sql_prompt('schema', 'question')} AS user_turn
FROM raw JOIN schemas USING (db_id)
""")
def prepare_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as examples over customers as databases: filtered, numbered, prompted."""
    prepared = prepare(_raw(spark, sf_dir), _customer_catalog(spark, sf_dir), "/data")
    return prepared.select(
        "split", "id", "db_id", "db_path", "question", "gold_sql", "schema",
        F.col("messages")[0]["content"].alias("system_turn"),
        F.col("messages")[1]["content"].alias("user_turn"),
    )


@query(f"""
WITH {_PREPARED_SQL}
SELECT split,
  CASE WHEN c_acctbal >= 0 THEN 'bad schema' ELSE 'missing database' END AS reason,
  count(*) AS n
FROM raw LEFT JOIN customer ON c_custkey = CAST(db_id AS BIGINT)
WHERE db_id NOT IN (SELECT db_id FROM schemas)
GROUP BY ALL
""")
def prepare_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many examples preparation leaves out, and why."""
    return skip_counts(_raw(spark, sf_dir), _customer_catalog(spark, sf_dir))


def _array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """JSON texts as the lines of one JSON array."""
    lead = "["
    for batch in batches:
        lines = []
        for text in batch.column(0).to_pylist():
            lines.append(lead + text)
            lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    closing = "[]" if lead == "[" else "]"
    yield pa.RecordBatch.from_arrays([pa.array([closing])], names=["value"])


@query("""
SELECT CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 2 ELSE 3 END AS file_no,
  row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS pos,
  'db_' || conv_id AS db_id, text AS question,
  CASE role WHEN 'user' THEN 'SELECT ' || turn WHEN 'assistant' THEN 'VALUES ' || turn
       WHEN 'system' THEN NULL ELSE '' END AS gold_sql
FROM conversations WHERE role IN ('user', 'assistant', 'system')
""")
def raw_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON array files of three kinds, a missing one among them, read as one split."""
    chat = table(spark, sf_dir, "conversations")
    base = [F.concat(F.lit("db_"), F.col("conv_id").cast("string")).alias("db_id"),
            F.col("text").alias("question")]
    query_key = F.concat(F.lit("SELECT "), F.col("turn").cast("string")).alias("query")
    other_key = F.concat(F.lit("VALUES "), F.col("turn").cast("string")).alias("SQL")
    kinds = {
        "user": [*base, query_key],
        "assistant": [*base, other_key],
        "system": [*base, F.lit(None).cast("string").alias("query"), other_key],
    }
    paths = []
    for role, fields in kinds.items():
        path = new_path(spark, "split")
        texts = (
            chat.where(F.col("role") == role)
            .repartition(1)  # a JSON array is one file
            .sortWithinPartitions("conv_id", "turn")
            .select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
        )
        texts.mapInArrow(_array_lines, "value string").write.text(path)
        paths.append(path)
    listed = [paths[0], new_path(spark, "missing"), paths[1], paths[2]]
    split = read_raw_split(spark, listed)
    placed = split.select("file_no", F.col("pos").alias("_at"), "db_id", "question", "gold_sql")
    return number_rows(placed, ["_at"], ["file_no"], "pos").drop("_at")


@query(f"""
SELECT doc_id AS id, source AS db_id, text AS question,
  CASE WHEN lang = 'en' THEN 'SELECT ' || n_chars END AS gold_sql,
  2 AS turns, {sql_prompt("'CREATE TABLE ' || source", "text")} AS user_turn
FROM documents
""")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared examples written as JSON lines and read back with declared types."""
    schema = F.concat(F.lit("CREATE TABLE "), F.col("source"))
    prepared = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("db_id"),
        F.col("text").alias("question"),
        F.when(
            F.col("lang") == "en", F.concat(F.lit("SELECT "), F.col("n_chars").cast("string"))
        ).alias("gold_sql"),
        build_messages(schema, F.col("text")).alias("messages"),
    )
    path = new_path(spark, "examples")
    write_json_lines(prepared, path)
    return read_examples(spark, path, allow_empty=False).select(
        "id", "db_id", "question", "gold_sql",
        F.size("messages").alias("turns"),
        F.col("messages")[1]["content"].alias("user_turn"),
    )


@query("""
SELECT id, question FROM (
  SELECT doc_id AS id, text AS question, row_number() OVER (ORDER BY doc_id) AS r FROM documents
) WHERE r <= 150
""")
def json_lines_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 150 examples of several files of JSON lines, the later files not read."""
    path = new_path(spark, "examples")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("question")
    )
    write_json_lines(docs.repartitionByRange(8, "id").sortWithinPartitions("id"), path)
    return read_examples(spark, path, limit=150).select("id", "question")


def _chat_messages() -> Column:
    schema = F.concat(F.lit("CREATE TABLE c_"), F.col("conv_id").cast("string"))
    return build_messages(schema, F.col("text"))


_CHAT_PROMPT = sql_prompt("'CREATE TABLE c_' || conv_id", "text")


@query(f"""
SELECT conv_id, turn,
  {sql_turns(("system", _SYSTEM), ("user", _CHAT_PROMPT)) + SQL_ASK} AS prompt_text,
  {sql_turns(("system", _SYSTEM), ("user", _CHAT_PROMPT), ("assistant", "'SELECT '"))} || turn AS full_text
FROM conversations
""")
def render_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as text: open for the model, and closed by the gold answer."""
    answer = F.concat(F.lit("SELECT "), F.col("turn").cast("string"))
    chat = table(spark, sf_dir, "conversations").withColumn("messages", _chat_messages())
    return chat.select(
        "conv_id", "turn",
        TEMPLATE.render(F.col("messages"), True).alias("prompt_text"),
        TEMPLATE.render(append_answer(F.col("messages"), answer), False).alias("full_text"),
    )


@query(f"""
SELECT conv_id, turn, 'model-' || role AS model, 256 AS max_tokens, 0.0::DOUBLE AS temperature,
  2 AS n_messages, {_CHAT_PROMPT} AS user_turn
FROM conversations
""")
def request_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat request bodies, taken apart again."""
    chat = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        request_body(F.concat(F.lit("model-"), F.col("role")), _chat_messages(), 256).alias("body"),
    )
    body_type = f"model string, messages {MESSAGES_TYPE}, temperature double, max_tokens int"
    return chat.withColumn("body", F.from_json("body", body_type)).select(
        "conv_id", "turn", "body.model", "body.max_tokens", "body.temperature",
        F.size("body.messages").alias("n_messages"),
        F.col("body.messages")[1]["content"].alias("user_turn"),
    )


@query("""
SELECT event_id AS id, event_type AS question,
  CASE WHEN event_type <> 'error' THEN 'SELECT "' || event_type || '"' END AS content,
  CASE WHEN event_type IN ('click', 'view') THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE 0 END AS out_tokens,
  CASE WHEN event_type = 'click' THEN user_id ELSE 0 END AS prompt_tokens
FROM events
""")
def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response bodies with and without choices and usage, joined to their examples by id."""
    events = table(spark, sf_dir, "events").withColumnRenamed("event_id", "id")
    choice = F.struct(
        F.struct(F.concat(F.lit('SELECT "'), F.col("event_type"), F.lit('"')).alias("content"))
        .alias("message")
    )
    tokens = F.get_json_object("props", "$.k").cast("bigint")
    usage = F.when(
        F.col("event_type").isin("click", "view"),
        F.struct(
            tokens.alias("completion_tokens"),
            F.when(F.col("event_type") == "click", F.col("user_id")).alias("prompt_tokens"),
        ),
    )
    bodies = events.select(
        "id",
        F.to_json(
            F.struct(
                F.when(F.col("event_type") != "error", F.array(choice)).alias("choices"),
                usage.alias("usage"),
            )
        ).alias("body"),
    )
    parsed = bodies.select("id", parse_response(F.col("body")).alias("r")).select("id", "r.*")
    examples = events.select("id", F.col("event_type").alias("question"))
    return attach_completions(examples, parsed)
