"""Samples, token sequences and batch inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import MESSAGES_TYPE, SYSTEM_PROMPT, build_messages
from ..functions.text import extract_sql
from ..operators import inference as I
from ..operators import sampling as A
from ..operators import sequences as Q
from ..operators.ordering import batch_numbers
from ..sources.catalog import schema_text as catalog_schema
from .base import SQL_ASK, TEMPLATE, query, sql_text, sql_turns, table
from .prompts import sql_prompt

_SYSTEM = sql_text(SYSTEM_PROMPT)


@query("""
SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 256
""")
def sample_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible draw of 256 documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return A.seeded_sample(docs, "doc_id", 256, 42)


@query("SELECT conv_id, turn, text FROM conversations ORDER BY conv_id, turn LIMIT 200")
def head_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 turns."""
    chat = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return A.head_limit(chat, ["conv_id", "turn"], 200)


_SHORT, _NEVER = "n_chars < 200", "n_chars < 0"


def _refusal_sql(probe: str, what: str, rows: str) -> str:
    none = f"(SELECT count(*) FROM {rows}) = 0"
    return (
        f"SELECT {sql_text(probe)} AS probe, {none} AS refused, "
        f"CASE WHEN {none} THEN {sql_text(f'no {what} found')} END AS message"
    )


@query("\nUNION ALL\n".join([
    _refusal_sql("documents", "documents", "documents"),
    _refusal_sql("short documents", "documents", f"documents WHERE {_SHORT}"),
    _refusal_sql("impossible documents", "documents", f"documents WHERE {_NEVER}"),
    _refusal_sql("calibration", "examples", f"documents WHERE {_SHORT}"),
    _refusal_sql("calibration of nothing", "examples", f"documents WHERE {_NEVER}"),
    _refusal_sql("tables", "tables in 1", "lineitem WHERE l_orderkey = 1"),
    _refusal_sql("tables of nothing", "tables in none", f"documents WHERE {_NEVER}"),
]))
def empty_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What refuses to work on nothing, and that it does not refuse anything else."""
    docs = table(spark, sf_dir, "documents")
    examples = docs.select(
        F.col("doc_id").alias("id"), "source", F.col("text").alias("question"), "n_chars",
        F.concat(F.lit("CREATE TABLE "), F.col("source")).alias("schema"),
        F.lit(None).cast(MESSAGES_TYPE).alias("messages"),
    )
    catalog = table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_orderkey AS STRING) AS db_id", "'table' AS type",
        "'line_' || l_linenumber AS table_name", "'CREATE TABLE t (a INT)' AS ddl",
    )
    probes = {
        "documents": lambda: A.require_rows(docs, "documents"),
        "short documents": lambda: A.require_rows(docs.where(_SHORT), "documents"),
        "impossible documents": lambda: A.require_rows(docs.where(_NEVER), "documents"),
        "calibration": lambda: A.calibration_texts(examples.where(_SHORT), TEMPLATE),
        "calibration of nothing": lambda: A.calibration_texts(examples.where(_NEVER), TEMPLATE),
        "tables": lambda: catalog_schema(catalog, "1"),
        "tables of nothing": lambda: catalog_schema(catalog, "none"),
    }
    found = []
    for probe, work in probes.items():
        try:
            work()
            found.append((probe, False, None))
        except ValueError as error:
            found.append((probe, True, str(error)))
    return spark.createDataFrame(found, "probe string, refused boolean, message string")


def make_word_tokenizer() -> Q.Tokenize:
    """A stand-in tokenizer: one token per space-separated word, its id the word's length."""
    return lambda text: [len(word) for word in text.split(" ")]


word_lengths = Q.token_udf(make_word_tokenizer)


def sql_tokens(expression: str) -> str:
    return f"list_transform(string_split({expression}, ' '), lambda w: length(w))"


_DOC_TEXT = (
    sql_turns(("system", _SYSTEM), ("user", sql_prompt("'CREATE TABLE ' || source", "text")))
    + SQL_ASK
)
_SAMPLED_SQL = f"""
sampled AS (
  SELECT doc_id AS id, {_DOC_TEXT} AS text
  FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 256
)
"""


def _calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.lit(None).cast(MESSAGES_TYPE).alias("messages"),
        F.concat(F.lit("CREATE TABLE "), F.col("source")).alias("schema"),
        F.col("text").alias("question"),
    )
    return A.calibration_texts(examples, TEMPLATE, n_samples=256, seed=7)


@query(f"WITH {_SAMPLED_SQL} SELECT id, text FROM sampled")
def calibration_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered prompts of a reproducible draw."""
    return _calibration(spark, sf_dir)


@query(f"""
WITH {_SAMPLED_SQL},
ids AS (SELECT id, list_slice({sql_tokens('text')}, 1, 2048) AS ids FROM sampled)
SELECT id, len(ids) AS n_ids, list_sum(ids)::BIGINT AS sum_ids, len(ids) AS sum_mask FROM ids
""")
def calibration_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of those prompts, at the default length."""
    ids = Q.calibration_ids(_calibration(spark, sf_dir), word_lengths)
    return ids.select(
        "id",
        F.size("input_ids").alias("n_ids"),
        _sum("input_ids").alias("sum_ids"),
        _sum("attention_mask").alias("sum_mask"),
    )


def _sum(ids: str) -> Column:
    return F.aggregate(ids, F.lit(0).cast("bigint"), lambda total, x: total + x)


# Turns as training examples: the text is the question, the turn gives the answer.
_TURN_ID = "conv_id * 1000 + turn"
_TURN_PROMPT = sql_turns(
    ("system", _SYSTEM), ("user", sql_prompt("'CREATE TABLE c_' || conv_id", "text"))
)
_MAX_LEN = 1024
_ENCODED_SQL = f"""
texts AS (
  SELECT {_TURN_ID} AS id, {sql_tokens(_TURN_PROMPT + SQL_ASK)} AS prompt,
    {sql_tokens(f"{_TURN_PROMPT} || chr(10) || '[assistant] SELECT a, b FROM c_' || conv_id || ' WHERE turn = ' || turn")} AS full_ids
  FROM conversations
),
encoded AS (
  SELECT id, ids, list_transform(ids, lambda x, i: CASE WHEN i <= len(prompt) THEN -100 ELSE x END) AS labels
  FROM (SELECT id, prompt, list_slice(full_ids, 1, {_MAX_LEN}) AS ids FROM texts)
)
"""


def _turns(spark: SparkSession, sf_dir: str, batch_size: int | None = None) -> DataFrame:
    """Turns with messages and answer, in numbered batches if a size is given."""
    chat = table(spark, sf_dir, "conversations").select(
        F.expr(_TURN_ID).alias("id"), "conv_id", "turn", "text"
    )
    kept = ["id"]
    if batch_size:
        chat = batch_numbers(chat, ["id"], batch_size)
        kept.append("batch_id")
    schema = F.concat(F.lit("CREATE TABLE c_"), F.col("conv_id").cast("string"))
    answer = "'SELECT a, b FROM c_' || conv_id || ' WHERE turn = ' || turn"
    return chat.select(
        *kept,
        build_messages(schema, F.col("text")).alias("messages"),
        F.expr(answer).alias("gold_sql"),
    )


@query(f"""
WITH {_ENCODED_SQL}
SELECT id, len(ids) AS n_ids, list_sum(ids)::BIGINT AS sum_ids, list_sum(labels)::BIGINT AS sum_labels,
  len(list_filter(labels, lambda x: x = -100)) AS n_masked
FROM encoded
""")
def train_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training sequences in which only the answer is supervised."""
    encoded = Q.encode_examples(_turns(spark, sf_dir), word_lengths, TEMPLATE, _MAX_LEN)
    return encoded.select(
        "id",
        F.size("input_ids").alias("n_ids"),
        _sum("input_ids").alias("sum_ids"),
        _sum("labels").alias("sum_labels"),
        F.size(F.filter("labels", lambda x: x == Q.IGNORED)).alias("n_masked"),
    )


@query(f"""
WITH {_ENCODED_SQL},
batched AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 8 AS batch_id FROM encoded),
sized AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS width FROM batched)
SELECT id, batch_id, width, list_sum(ids)::BIGINT - (width - len(ids)) AS sum_ids,
  list_sum(labels)::BIGINT - 100 * (width - len(ids)) AS sum_labels, len(ids) AS sum_mask,
  CASE WHEN width > len(ids) THEN -1 ELSE ids[-1] END AS last_id
FROM sized
""")
def train_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of eight in id order, padded on the right."""
    encoded = Q.encode_examples(
        _turns(spark, sf_dir, 8), word_lengths, TEMPLATE, _MAX_LEN, ["id", "batch_id"]
    )
    padded = Q.pad_batches(encoded, -1)
    return padded.select(
        "id", "batch_id",
        F.size("labels").alias("width"),
        _sum("input_ids").alias("sum_ids"),
        _sum("labels").alias("sum_labels"),
        _sum("attention_mask").alias("sum_mask"),
        F.element_at("input_ids", -1).alias("last_id"),
    )


@query(f"""
WITH {_ENCODED_SQL},
cut AS (SELECT id, list_slice(prompt, 1, 2048) AS ids FROM texts),
batched AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 16 AS batch_id FROM cut),
sized AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS width FROM batched)
SELECT id, batch_id, width, width - len(ids) AS n_pad, list_sum(ids)::BIGINT - (width - len(ids)) AS sum_ids,
  CASE WHEN width > len(ids) THEN -1 ELSE ids[1] END AS first_id, 2 AS n_generated, id + id + 1 AS sum_generated
FROM sized
""")
def left_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of the default length padded on the left; the prompt stripped from the output."""
    prompts = _turns(spark, sf_dir, 16).select(
        "id",
        "batch_id",
        word_lengths(TEMPLATE.render(F.col("messages"), True)).alias("input_ids"),
    )
    padded = Q.prompt_batches(prompts, -1)
    answer = F.array(F.col("id").cast("int"), (F.col("id") + 1).cast("int"))
    generated = Q.strip_prompt(F.concat("input_ids", answer), F.size("input_ids"))
    return padded.withColumn("generated", generated).select(
        "id", "batch_id",
        F.size("input_ids").alias("width"),
        F.size(F.filter("attention_mask", lambda x: x == 0)).alias("n_pad"),
        _sum("input_ids").alias("sum_ids"),
        F.element_at("input_ids", 1).alias("first_id"),
        F.size("generated").alias("n_generated"),
        _sum("generated").alias("sum_generated"),
    )


def make_stub_generate() -> I.Generate:
    """A stand-in model that answers with the length of the last turn."""
    return lambda batch: [f"```sql\nSELECT {len(m[-1]['content'])};\n```" for m in batch]


@query(f"""
SELECT {_TURN_ID} AS id,
  '```sql' || chr(10) || 'SELECT ' || length({sql_prompt("'CREATE TABLE c_' || conv_id", "text")})
    || ';' || chr(10) || '```' AS raw,
  'SELECT ' || length({sql_prompt("'CREATE TABLE c_' || conv_id", "text")}) AS pred_sql
FROM conversations
""")
def complete_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of a stand-in model, in batches of eight, and the SQL in them."""
    done = I.complete(_turns(spark, sf_dir), make_stub_generate, 8)
    return done.select("id", "raw", extract_sql(F.col("raw")).alias("pred_sql"))


def make_stub_call() -> I.Call:
    """A stand-in endpoint that refuses long conversations."""

    def call(messages: I.Messages) -> dict:
        size = len(messages[-1]["content"])
        if size > 800:
            raise RuntimeError(f"{size} characters are too many")
        return {"completion_tokens": size} if size > 400 else {}

    return call


@query(f"""
WITH sized AS (
  SELECT {_TURN_ID} AS id, length({sql_prompt("'CREATE TABLE c_' || conv_id", "text")}) AS size
  FROM conversations
)
SELECT id, size <= 800 AS ok,
  CASE WHEN size <= 400 THEN 0 WHEN size <= 800 THEN size END AS out_tokens,
  CASE WHEN size <= 800 THEN 0 END AS prompt_tokens,
  CASE WHEN size > 800 THEN size || ' characters are too many' END AS error,
  true AS timed
FROM sized
""")
def timed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a stand-in endpoint, with errors captured per row."""
    calls = I.timed_calls(_turns(spark, sf_dir), make_stub_call, ["id"])
    timed = (F.col("latency") >= 0) & (F.col("end_ts") >= F.col("start_ts"))
    return calls.select(
        "id", "ok", "out_tokens", "prompt_tokens", "error", timed.alias("timed")
    )
