import json

import pytest
from pyspark.sql import functions as F

from sqlgauge.plans import prepare as R
from sqlgauge.sources import catalog as C
from sqlgauge.sources import examples as E
from sqlgauge.sources import reports as O
from sqlgauge.functions.prompts import SYSTEM_PROMPT


@pytest.fixture
def dumps(tmp_path):
    root = tmp_path / "catalogs"
    root.mkdir()

    def dump(name, *objects):
        lines = [json.dumps(dict(zip(("type", "table_name", "ddl"), o))) for o in objects]
        (root / f"{name}.json").write_text("\n".join(lines) + "\n", encoding="utf-8")

    dump(
        "harbour",
        ("table", "ships", "CREATE TABLE ships (hull TEXT, tons REAL)"),
        ("table", "berths", " CREATE TABLE berths (no INT);"),
        ("index", "ships_by_tons", "CREATE INDEX ships_by_tons ON ships(tons)"),
        ("view", "heavy", "CREATE VIEW heavy AS SELECT 1"),
    )
    dump(
        "counters",
        ("table", "sqlite_sequence", "CREATE TABLE sqlite_sequence(name, seq)"),
        ("table", "c", "CREATE TABLE c (k INTEGER PRIMARY KEY AUTOINCREMENT)"),
    )
    dump("bare", ("index", "nothing", None))
    (root / "torn.json").write_text("no json at all\n", encoding="utf-8")
    return str(root)


def test_catalog_and_schema_texts(spark, dumps, rows):
    catalog = C.read_catalog(spark, dumps)
    assert dict(rows(C.schema_texts(catalog))) == {
        "harbour": "CREATE TABLE berths (no INT);\n\nCREATE TABLE ships (hull TEXT, tons REAL);",
        "counters": "CREATE TABLE c (k INTEGER PRIMARY KEY AUTOINCREMENT);",
    }
    assert rows(catalog.where("db_id = 'torn'")) == [("torn", None, None, None)]
    assert C.schema_text(catalog, "counters").count() == 1
    with pytest.raises(ValueError):
        C.schema_text(catalog, "bare")


def test_catalog_of_many_databases_in_one_file(spark, tmp_path, rows):
    lines = [
        b'{"db_id": "a", "type": "table", "table_name": "x", "ddl": "CREATE TABLE x (\xe2\x82 t INT)"}',
        b"  ",
        b'{"db_id": "b", "type": "table", "table_name": "y", "ddl": "CREATE TABLE y (\xc3\xa9 INT)"}',
        b'{"type": "table", "table_name": "z", "ddl": "CREATE TABLE z (a INT)"}',
        b"{torn",
    ]
    (tmp_path / "all.json").write_bytes(b"\n".join(lines))
    catalog = C.read_catalog(spark, str(tmp_path))
    assert dict(rows(C.schema_texts(catalog))) == {
        "a": "CREATE TABLE x ( t INT);", "b": "CREATE TABLE y (é INT);", "all": "CREATE TABLE z (a INT);",
    }
    assert ("all", None, None, None) in rows(catalog) and catalog.count() == 4


def test_internal_names(spark, rows):
    names = ["sqlite_stat1", "SQLiteX", "sqlite", "sqlit_e", "my_sqlite_x"]
    catalog = spark.createDataFrame(
        [("d", "table", n, f" CREATE TABLE {n} (a) ;;") for n in names]
        + [("d", "view", "v", "CREATE VIEW v"), ("d", "table", "auto", None)],
        C.CATALOG_TYPE,
    )
    kept = sorted(r[2] for r in rows(catalog.where(C.is_user_table())))
    assert kept == ["my_sqlite_x", "sqlit_e", "sqlite"]


def write_array(path, examples):
    path.write_text(json.dumps(examples, indent=1), encoding="utf-8")
    return str(path)


def test_raw_split_order_keys_and_missing_file(spark, tmp_path, caplog, rows):
    first = write_array(tmp_path / "z.json", [
        {"db_id": "shop", "question": "q0", "query": "SELECT 0", "SQL": "no", "sql": {"a": [1]}},
        {"db_id": "shop", "question": "q1", "SQL": "SELECT 1"},
    ])
    second = write_array(tmp_path / "a.json", [
        {"db_id": "gone", "question": "q2"},
        {"db_id": "shop", "question": "q3", "query": None, "SQL": "SELECT 3"},
    ])
    raw = E.read_raw_split(spark, [first, str(tmp_path / "missing.json"), second])
    got = rows(raw.orderBy("file_no", "pos").select("file_no", "question", "gold_sql"))
    assert got == [
        (0, "q0", "SELECT 0"), (0, "q1", "SELECT 1"), (2, "q2", ""), (2, "q3", None),
    ]
    assert "missing.json" in caplog.text
    assert E.read_raw_split(spark, [str(tmp_path / "missing.json")]).count() == 0


def test_prepare(spark, dumps, tmp_path, rows):
    names = ["harbour", "gone", "counters", "bare", "torn", "harbour", "harbour"]
    path = write_array(tmp_path / "train.json", [
        {"db_id": name, "question": f" q{i} é", "query": f"SELECT {i}"}
        for i, name in enumerate(names)
    ])
    raw = E.read_raw_split(spark, [path, path])
    raw = raw.withColumn("split", F.when(F.col("file_no") == 0, "train").otherwise("dev"))
    catalog = C.read_catalog(spark, dumps)
    prepared = R.prepare_examples(raw, catalog, "/data")
    got = rows(prepared.orderBy("split", "id").select("split", "id", "question", "db_path"))
    expected = [(0, 0, "harbour"), (1, 2, "counters"), (2, 5, "harbour"), (3, 6, "harbour")]
    assert got == [
        (split, i, f" q{n} é", f"/data/database/{db}/{db}.sqlite")
        for split in ("dev", "train") for i, n, db in expected
    ]
    turns = prepared.where("split = 'train' AND id = 0").first().messages
    assert turns[0].content == SYSTEM_PROMPT
    assert turns[1].content.startswith("Database schema:\nCREATE TABLE berths")
    assert turns[1].content.endswith("Question: q0 é\n\nSQL:")
    counts = {tuple(r[:2]): r[2] for r in rows(R.skip_counts(raw, catalog))}
    assert counts == {
        (s, r): n for s in ("train", "dev")
        for r, n in (("missing database", 1), ("bad schema", 2))
    }

    out = str(tmp_path / "prepared")
    O.write_json_lines(prepared.drop("split"), out)
    back = E.read_examples(spark, out)
    assert sorted(map(str, rows(back))) == sorted(map(str, rows(prepared.drop("split"))))
    text = "".join(p.read_text("utf-8") for p in (tmp_path / "prepared").glob("part-*"))
    assert "é" in text


def test_database_path(spark):
    df = spark.createDataFrame([("d", True), ("d", False)], "db string, test boolean")
    got = [r[0] for r in df.select(R.database_path("/r", F.col("db"), F.col("test"))).collect()]
    assert got == ["/r/test_database/d/d.sqlite", "/r/database/d/d.sqlite"]


def test_json_lines_limit_blank_and_malformed(spark, tmp_path, rows):
    path = tmp_path / "d.jsonl"
    lines = [json.dumps({"id": 100 - i, "question": f"q{i}"}) for i in range(50)]
    path.write_text("\n\n  \n".join(lines) + "\n")
    assert E.read_examples(spark, str(path)).count() == 50
    for limit, want in ((3, 3), (0, 50), (None, 50), (99, 50)):
        assert E.read_examples(spark, str(path), limit=limit).count() == want
    head = rows(E.read_examples(spark, str(path), limit=3).select("question"))
    assert sorted(head) == [("q0",), ("q1",), ("q2",)]
    path.write_text('{"id": 1}\n{broken\n')
    with pytest.raises(Exception, match="MALFORMED"):
        E.read_examples(spark, str(path)).collect()
    path.write_text("\n \n")
    with pytest.raises(ValueError):
        E.read_examples(spark, str(path), allow_empty=False)


@pytest.mark.parametrize("folders", [False, True])
def test_reports_keep_nulls_and_configs(spark, tmp_path, folders):
    path = str(tmp_path / "metrics")
    reports = spark.createDataFrame(
        [("a", "m", None, 3, {"match": 2}), ("b", "m", "lora", 0, {})],
        "config string, model string, adapter string, n bigint, status_counts map<string,bigint>",
    )
    O.write_reports(reports, path, folder_per_config=folders)
    assert '"adapter":null' in "".join(
        p.read_text() for p in (tmp_path / "metrics").glob("config=a/part-*" if folders else "part-*")
    )
    back = O.read_reports(spark, path, O.METRICS_TYPE)
    got = {r.config: (r.model, r.adapter, r.n, r.status_counts) for r in back.collect()}
    assert got == {"a": ("m", None, 3, {"match": 2}), "b": ("m", "lora", 0, {})}


ODD_NAMES = ["a b+c", "x/y=%2F", "ü", "007", "", ".", "..", "_x", ".y", "config=a", "50%"]


def test_results_tree_layout_and_odd_names(spark, tmp_path):
    root = tmp_path / "tree"
    metrics = spark.createDataFrame(
        [(n, 0.5, None) for n in ODD_NAMES], "config string, execution_accuracy double, model string"
    )
    O.write_results_tree(metrics.repartition(3), str(root), "metrics.json")
    O.write_results_tree(metrics.repartition(2), str(root), "metrics.json")  # replaced, not doubled
    written = sorted(root.glob("*/metrics.json"))
    assert len(written) == len(ODD_NAMES)
    assert json.loads((root / "ü" / "metrics.json").read_text()) == {
        "execution_accuracy": 0.5, "model": None
    }
    assert json.loads((root / "50%" / "metrics.json").read_text())["execution_accuracy"] == 0.5
    assert {p.name for p in root.iterdir() if not p.name.startswith("config=")} == {
        "a b+c", "ü", "007", "50%", "_staging"
    }
    assert not list((root / "_staging").rglob("*"))
    back = O.read_results_tree(spark, f"file://{root}").collect()
    assert sorted(r.config for r in back) == sorted(ODD_NAMES)


def test_results_tree_layouts_side_by_side(spark, tmp_path):
    root = tmp_path / "tree"
    for name, file, text in [
        ("both", "metrics.json", '{"execution_accuracy":\n 0.25, "extra": [1]}\n'),
        ("both", "latency.json", '{"latency_ms": {"p50": 1.5, "p99": 9}}'),
        ("only latency", "latency.json", "{}"),
        ("blank", "metrics.json", " \n"),
        ("neither", "other.json", "{}"),
        ("deep/er", "metrics.json", "{}"),
    ]:
        (root / name).mkdir(parents=True, exist_ok=True)
        (root / name / file).write_text(text)
    (root / "metrics.json").mkdir()
    reports = spark.createDataFrame([("by spark", 0.5), ("a/b", 0.75)], "config string, execution_accuracy double")
    reports.write.mode("append").partitionBy("config").json(str(root / "metrics.json"))
    reports.where("config = 'by spark'").selectExpr("0.125D AS execution_accuracy").write.json(
        str(root / "a folder" / "metrics.json")
    )
    got = {r.config: (r.execution_accuracy, r.p50_ms, r.p99_ms) for r in O.read_results_tree(spark, str(root)).collect()}
    assert got == {
        "both": (0.25, 1.5, 9.0), "only latency": (None, None, None),
        "by spark": (0.5, None, None), "a/b": (0.75, None, None), "a folder": (0.125, None, None),
    }
    (root / "both" / "metrics.json").write_text("{broken")
    with pytest.raises(Exception, match="MALFORMED"):
        O.read_results_tree(spark, str(root)).collect()
    with pytest.raises(ValueError):
        O.read_results_tree(spark, str(tmp_path / "nowhere"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        O.read_results_tree(spark, str(tmp_path / "empty"))


def test_results_tree_refuses_what_cannot_be_one_file(spark, tmp_path):
    schema = "config string, execution_accuracy double"
    for rows_ in ([(None, 0.5)], [("a", 0.5), ("a", 0.25)]):
        with pytest.raises(ValueError):
            O.write_results_tree(spark.createDataFrame(rows_, schema), str(tmp_path / "t"), "m.json")
    O.write_results_tree(spark.createDataFrame([], schema), str(tmp_path / "t"), "metrics.json")


def test_a_failed_task_publishes_nothing(tmp_path):
    import pyarrow as pa

    from sqlgauge.sources.tree import ReportWriter

    good = pa.RecordBatch.from_pydict({"config": ["a", "b"], "value": ["{}", "{}"]})

    def breaking():
        yield good
        raise RuntimeError("lost")

    writer = ReportWriter(f"file:{tmp_path}", "metrics.json")
    with pytest.raises(RuntimeError):
        writer.write(breaking())
    assert not list(tmp_path.glob("*/metrics.json"))
    assert writer.write(iter([good])).files == writer.write(iter([good])).files == 2
    writer.commit([])
    assert sorted(p.parent.name for p in tmp_path.glob("*/metrics.json")) == ["a", "b"]
    assert not list((tmp_path / "_staging").iterdir())
    writer.abort([])
