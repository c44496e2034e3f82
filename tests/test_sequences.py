import pytest
from pyspark.sql import functions as F

from sqlgauge.functions.prompts import MESSAGES_TYPE
from sqlgauge.registry.base import TEMPLATE
from sqlgauge.operators import inference as I
from sqlgauge.operators import sampling as A
from sqlgauge.operators import sequences as S
from sqlgauge.operators.latency import latency_report, log_from_calls


def make_tokenizer():
    return lambda text: [ord(c) for c in text]


tokenize = S.token_udf(make_tokenizer)
EXAMPLES = f"id bigint, messages {MESSAGES_TYPE}, schema string, question string, gold_sql string"


def examples(spark, count):
    return spark.createDataFrame(
        [(i, [("user", f"Q{i}" * (i % 4 + 1))], "S", "q", f"SELECT {i}") for i in range(count)],
        EXAMPLES,
    )


def test_token_udf_null_and_unicode(spark):
    df = spark.createDataFrame([("aé",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(tokenize(F.col("t"))).collect()] == [[97, 233], None, []]


@pytest.mark.parametrize("max_len", [4, 12, 18, 500])
def test_only_the_answer_is_supervised(spark, max_len):
    df = examples(spark, 8)
    encoded = S.encode_examples(df, tokenize, TEMPLATE, max_len)
    assert encoded.columns == ["id", "input_ids", "labels"]
    for i, ids, labels in encoded.collect():
        question = f"Q{i}" * (i % 4 + 1)
        full = [ord(c) for c in f"[user] {question}\n[assistant] SELECT {i}"][:max_len]
        prompt = len(f"[user] {question}\n[assistant]")
        assert ids == full
        assert labels == [-100] * min(prompt, len(full)) + full[prompt:]


def test_padding(spark):
    df = spark.createDataFrame(
        [(0, [1, 2, 3], [-100, 2, 3]), (0, [4], [4]), (1, [5, 6], [5, -100]), (1, [], [])],
        "batch_id bigint, input_ids array<int>, labels array<int>",
    )
    got = sorted(map(tuple, S.pad_batches(df, 0).select(*df.columns, "attention_mask").collect()))
    assert got == [
        (0, [1, 2, 3], [-100, 2, 3], [1, 1, 1]),
        (0, [4, 0, 0], [4, -100, -100], [1, 0, 0]),
        (1, [0, 0], [-100, -100], [0, 0]),
        (1, [5, 6], [5, -100], [1, 1]),
    ]


def test_prompt_batches_pad_left_and_cut(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 4]), (0, [9])], "batch_id int, input_ids array<int>")
    got = S.prompt_batches(df, 7, max_len=3)
    rows = sorted(map(tuple, got.select("input_ids", "attention_mask").collect()))
    assert rows == [([1, 2, 3], [1, 1, 1]), ([7, 7, 9], [0, 0, 1])]
    generated = got.withColumn("out", F.concat("input_ids", F.array(F.lit(50), F.lit(51))))
    stripped = generated.select(S.strip_prompt(F.col("out"), F.size("input_ids"))).collect()
    assert [r[0] for r in stripped] == [[50, 51], [50, 51]]


def test_calibration(spark):
    df = examples(spark, 20)
    draw = lambda seed, n=5: [
        r.text for r in A.calibration_texts(df, TEMPLATE, n_samples=n, seed=seed).collect()
    ]
    assert draw(7) == draw(7) != draw(8)
    assert len(draw(7)) == 5 and len(draw(7, 99)) == 20
    assert all(t.startswith("[user] Q") and t.endswith("\n[assistant]") for t in draw(7))
    again = A.seeded_sample(df.repartition(5), "id", 5, 7)
    assert sorted(r.id for r in again.collect()) == sorted(
        r.id for r in A.seeded_sample(df, "id", 5, 7).collect()
    )
    with pytest.raises(ValueError):
        A.calibration_texts(df.where("id < 0"), TEMPLATE)


def test_calibration_falls_back_and_tokenizes(spark):
    df = spark.createDataFrame([(1, None, "CREATE TABLE t (a)", "Qx", "")], EXAMPLES)
    texts = A.calibration_texts(df, TEMPLATE, n_samples=1)
    text = texts.first().text
    assert "Qx" in text and "CREATE TABLE t (a)" in text
    ids = S.calibration_ids(texts, tokenize, max_len=10).first()
    assert ids.input_ids == [ord(c) for c in text[:10]] and ids.attention_mask == [1] * 10


def test_head_limit(spark):
    df = spark.range(100).repartition(7)
    assert sorted(r.id for r in A.head_limit(df, ["id"], 3).collect()) == [0, 1, 2]
    assert A.head_limit(df, ["id"], 0).count() == A.head_limit(df, ["id"], None).count() == 100


def test_complete_batches(spark):
    def make_generate():
        def generate(batch):
            assert len(batch) <= 3
            return [f"{len(batch)}:{m[-1]['role']}:{m[-1]['content']}" for m in batch]

        return generate

    done = I.complete(examples(spark, 20).coalesce(1), make_generate, batch_size=3)
    assert done.columns[-1] == "raw" and len(done.columns) == 6
    got = {r.id: r for r in done.collect()}
    assert [got[i].raw for i in (0, 19)] == ["3:user:Q0", "2:user:Q19Q19Q19Q19"]
    assert got[5].messages[0].content == "Q5Q5"


def test_wrong_number_of_completions_fails(spark):
    with pytest.raises(Exception, match="gave 0 completions"):
        I.complete(examples(spark, 2).coalesce(1), lambda: lambda batch: []).collect()


def test_timed_calls_capture_errors(spark):
    def make_call():
        def call(messages):
            if "Q3" in messages[0]["content"]:
                raise RuntimeError("refused")
            return {"completion_tokens": 4} if "Q1" in messages[0]["content"] else {}

        return call

    calls = I.timed_calls(examples(spark, 6), make_call, ["id"])
    got = {r.id: r for r in calls.collect()}
    assert (got[3].ok, got[3].error, got[3].out_tokens) == (False, "refused", None)
    assert (got[1].ok, got[1].error, got[1].out_tokens, got[1].prompt_tokens) == (True, None, 4, 0)
    assert all(r.latency >= 0 and r.end_ts >= r.start_ts for r in got.values())
    log = log_from_calls(calls).withColumn("config", F.lit("c"))
    report = latency_report(log).first()
    assert (report.num_requests, report.failed, report.output_tokens_total) == (6, 1, 4)


def test_top_rows_are_chosen_on_narrow_columns(spark):
    wide = spark.range(1000).withColumn("text", F.repeat(F.lit("x"), 100))
    assert A.head_limit(wide, ["id"], 5).count() == 5
    drawn = A.seeded_sample(wide, "id", 10)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan
    assert drawn.count() == 10


def test_calibration_draw_of_nulls_and_twins(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "id bigint, t string")
    assert A.seeded_sample(df, "id", 99).count() == 3
    assert A.seeded_sample(df.where("id IS NULL AND t = 'z'"), "id", 9).count() == 0
