import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sqlgauge.functions import prompts as P
from sqlgauge.functions import text as X
from sqlgauge.registry.base import TEMPLATE
from sqlgauge.registry.prompts import sql_extraction

CASES = [
    ("SELECT a FROM t", "SELECT a FROM t"),
    ("```sql\nSELECT a FROM t\n```", "SELECT a FROM t"),
    ("```\nSELECT 1\n```", "SELECT 1"),
    ("SQL: SELECT a FROM t", "SELECT a FROM t"),
    ("query:  SELECT 1", "SELECT 1"),
    ("SELECT 1; SELECT 2", "SELECT 1"),
    ("SELECT a FROM t;\nThis query returns all rows.", "SELECT a FROM t"),
    ("SELECT a\n  FROM   t", "SELECT a FROM t"),
    ("```sql\nSQL: SELECT 1\n```", "SELECT 1"),
    ("", ""),
    (None, ""),
    ("   \n  ", ""),
    # quirks that must stay
    ("```sqlite\nSELECT 1\n```", "ite SELECT 1"),
    ("```sql\nSELECT 1", "```sql SELECT 1"),
    ("SELECT ';' AS x", "SELECT '"),
    ("sql: query: SELECT 1", "query: SELECT 1"),
    ("``````", ""),
    ("``` \n ``` SELECT 1", ""),
    ("Sure:\n```SQL\nSELECT 1;\n```\n```sql\nSELECT 2\n```", "SELECT 1"),
    ("query without: SELECT 1", "query without: SELECT 1"),
    ("SELECT a::INT", "SELECT a::INT"),
    ("SQLite :　SELECT\xa01\x1f", "SELECT 1"),
    ("\x1c SELECT\x85a ", "SELECT a"),
]


@pytest.mark.parametrize("spaces", ["", "\x1c 　"])
def test_extract_sql(spark, spaces):
    data = [(None if raw is None else spaces + raw + spaces, want) for raw, want in CASES]
    df = spark.createDataFrame(data, "raw string, want string")
    for raw, want, got in df.withColumn("got", X.extract_sql(F.col("raw"))).collect():
        assert got == want, raw


def test_extraction_equals_regular_expressions_of_another_engine(spark):
    rng = random.Random(11)
    pieces = ["```", "`", "sql", "SQL", "ite", ":", "query", ";", " ", "\n", "\u3000", "\x1d", "x", "é"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = dict(map(tuple, df.select("n", X.extract_sql(F.col("t"))).collect()))
    connection = duckdb.connect()
    connection.execute("CREATE TABLE texts (n INT, raw VARCHAR)")
    connection.executemany("INSERT INTO texts VALUES (?, ?)", list(enumerate(texts)))
    expected = dict(connection.execute(sql_extraction("texts", "n", "raw")).fetchall())
    assert {n: (texts[n], s) for n, s in got.items()} == {
        n: (texts[n], s) for n, s in expected.items()
    }


def test_strip_and_collapse_agree_with_python(spark):
    rng = random.Random(1)
    alphabet = X.WHITESPACE + "ab;é​中"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", X.strip(F.col("t")), X.collapse_whitespace(F.col("t"))
    )
    for text, stripped, collapsed in df.collect():
        assert stripped == text.strip()
        assert collapsed == " ".join(text.split())


def test_whitespace_is_what_python_strips():
    everything = {chr(c) for c in range(0x110000) if chr(c).isspace()}
    assert everything == set(X.WHITESPACE)
    assert len(X.WHITESPACE) == len(everything)


def test_clean_ddl(spark):
    df = spark.createDataFrame([("  CREATE TABLE t (a);; \n",), ("x ; ;",)], "d string")
    got = [r[0] for r in df.select(X.clean_ddl(F.col("d"))).collect()]
    assert got == ["CREATE TABLE t (a)", "x ; "]


def prompt(spark, schema, question, evidence):
    df = spark.createDataFrame([(schema, question, evidence)], "s string, q string, e string")
    return df.select(P.user_prompt(F.col("s"), F.col("q"), F.col("e"))).first()[0]


def test_user_prompt(spark):
    plain = prompt(spark, " CREATE TABLE t (a INT);\n", " How many rows? ", None)
    assert plain == (
        "Database schema:\nCREATE TABLE t (a INT);\n\nQuestion: How many rows?\n\nSQL:"
    )
    assert prompt(spark, "S", "Q", "") == "Database schema:\nS\n\nQuestion: Q\n\nSQL:"
    assert "\n\nKnowledge: use column x\n\nQuestion" in prompt(spark, "S", "Q", " use column x")
    assert "Knowledge: \n" in prompt(spark, "S", "Q", "   ")


def test_messages_and_fallback(spark):
    df = spark.createDataFrame(
        [(None, "S", "Q"), ([], "S", "Q"), ([("user", "kept")], "S", "Q")],
        f"messages {P.MESSAGES_TYPE}, schema string, question string",
    )
    got = df.select(
        P.messages_or_default(F.col("messages"), F.col("schema"), F.col("question"))
    ).collect()
    for (turns,) in got[:2]:
        assert [t.role for t in turns] == ["system", "user"]
        assert turns[0].content == P.SYSTEM_PROMPT
        assert "Q" in turns[1].content
    assert [tuple(t) for t in got[2][0]] == [("user", "kept")]


def test_render_and_append(spark):
    df = spark.createDataFrame([([("system", "S"), ("user", "Q1")],)], f"m {P.MESSAGES_TYPE}")
    whole = P.append_answer(F.col("m"), F.lit("SELECT 1"))
    got = df.select(
        TEMPLATE.render(F.col("m"), True), TEMPLATE.render(whole, False)
    ).first()
    assert tuple(got) == (
        "[system] S\n[user] Q1\n[assistant]", "[system] S\n[user] Q1\n[assistant] SELECT 1"
    )


def test_request_and_response(spark):
    df = spark.createDataFrame([([("user", 'say "é"')],)], f"m {P.MESSAGES_TYPE}")
    body = df.select(P.request_body(F.lit("m1"), F.col("m"), 256)).first()[0]
    assert body == (
        '{"model":"m1","messages":[{"role":"user","content":"say \\"é\\""}],'
        '"temperature":0.0,"max_tokens":256}'
    )
    bodies = [
        ('{"choices":[{"message":{"content":"SELECT 1"}}],"usage":{"completion_tokens":3}}',),
        ('{"choices":[]}',),
    ]
    parsed = spark.createDataFrame(bodies, "b string").select(P.parse_response(F.col("b")))
    assert [tuple(r[0]) for r in parsed.collect()] == [("SELECT 1", 3, 0), (None, 0, 0)]


BROKEN = [
    b"", b"plain", "é€😀�".encode(), b"\xff", b"a\xe2\x82b", b"\xe2\x82\xac\xe2\x82",
    b"\xc3\xa9\xc3", b"\xed\xa0\x80x", b"\xf0\x90A\x80", b"\xc0\xaf\xc1\xbf", b"\xf4\x90\x80\x80z",
    b"\x80\xbf\xef\xbf\xbd", b"\xe0\x80\x80\xe0\xa0\x80", b"\xf8\x88\x80\x80\x80", b"\x00\x7f\xc2\x80",
    b"\xe2\xc3\xa9", b"ok \xf0\x9f\x98\x80 \xf0\x9f\x98", b"x" * 200_000 + b"\xfe" + b"y" * 200_000,
]


def test_bytes_of_no_character_are_dropped(spark):

    from sqlgauge.functions.text import decode_utf8

    rng = random.Random(4)
    lots = [0x20, 0x41, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC2, 0xDF, 0xE0, 0xE2, 0xED, 0xEF, 0xF0,
            0xF1, 0xF4, 0xF5, 0xFF]
    data = BROKEN + [bytes(rng.choices(lots, k=rng.randrange(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)] + [(-1, None)], "i int, d binary")
    got = {r.i: r.t for r in df.select("i", decode_utf8(F.col("d")).alias("t")).collect()}
    assert got.pop(-1) is None
    assert [got[i] for i in range(len(data))] == [d.decode("utf-8", "ignore") for d in data]
