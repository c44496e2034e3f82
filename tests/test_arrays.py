import json
import random

import pytest

from sqlgauge.session import temporary_conf
from sqlgauge.sources import examples as E
from sqlgauge.sources.arrays import _cut_block, _opened, _Start, read_array_objects, scan_blocks

SPLITS = {
    "spark.sql.files.maxPartitionBytes": "64b", "spark.sql.files.openCostInBytes": "1b",
    "spark.sql.files.minPartitionNum": "40",
}


def odd_text(rng):
    parts = ['}', '{', '"', '\\', '\\"', "},{", "]", "[", " é😀 ", "\n", '"}', "x" * 90, ""]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(6)))


def corpus(seed, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        row = {"db_id": f"d{i}", "question": odd_text(rng), "query": odd_text(rng)}
        if i % 3 == 0:
            row["sql"] = {"a": [{"b": odd_text(rng)}, {}], "c": {"d": {"e": 1}}}
        out.append(row)
    return out


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("ascii_", [True, False])
def test_objects_of_any_split(spark, tmp_path, indent, ascii_):
    rows = corpus(indent or 0)
    path = tmp_path / "a.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=ascii_), encoding="utf-8")
    with temporary_conf(spark, SPLITS):
        lines = spark.read.option("lineSep", "}").text(str(path))
        assert lines.select("_metadata.file_block_start").distinct().count() > 20
        found = read_array_objects(spark, str(path))
        assert [json.loads(r.value) for r in found.orderBy("pos").collect()] == rows
        split = E.read_raw_split(spark, [str(path), str(path)])
        got = [tuple(r) for r in split.orderBy("file_no", "pos").drop("pos").collect()]
    want = [(r["db_id"], r["question"], r["query"]) for r in rows]
    assert got == [(k, *w) for k in range(2) for w in want]


def test_one_long_object_across_many_blocks(spark, tmp_path):
    rows = [{"q": "}{" * 400, "z": [{"y": "\\"}] * 30}, {"q": '"'}]
    path = tmp_path / "a.json"
    path.write_text("\n [ " + " , \n".join(json.dumps(r) for r in rows) + " ]\n\n")
    with temporary_conf(spark, SPLITS):
        found = read_array_objects(spark, str(path)).orderBy("pos").collect()
    assert [json.loads(r.value) for r in found] == rows


def test_folders_of_files_and_empty_arrays(spark, tmp_path):
    for name, rows in (("b", [{"a": 1}]), ("a", [{"a": 0}, {}]), ("c", []), ("d", [{"a": 2}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    found = read_array_objects(spark, str(tmp_path)).orderBy("pos").collect()
    assert [json.loads(r.value) for r in found] == [{"a": 0}, {}, {"a": 1}, {"a": 2}]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.json").write_text(" [ ]\n")
    assert read_array_objects(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize(
    "text",
    ['[{"a": 1}', '{"a": 1}', '[{"a": 1} {"a": 2}]', '[{"a": 1}], ', '[{"a": "}]', '[1, {"a": 2}]',
     '[{"a": 1}]]', "[}]", '[{"a": 1}, 5]', "nothing", '[{"a": 1},]'],
)
def test_what_is_no_array_of_objects_fails(spark, tmp_path, text):
    path = tmp_path / "a.json"
    path.write_text(text)
    if text.endswith(",]"):  # told apart from a complete array by its rest
        with pytest.raises(Exception, match="no JSON array"):
            read_array_objects(spark, str(path))
        return
    with pytest.raises(Exception, match="no JSON array"):
        read_array_objects(spark, str(path)).collect()


def test_wrong_fields_fail(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[{"db_id": "x", "question" 5}]')
    with pytest.raises(Exception, match="MALFORMED"):
        E.read_raw_split(spark, [str(path)]).collect()


def test_blocks_by_hand():
    assert _opened(b'{"a": "{", "b": {') == (6, 2, 1)
    assert _opened(rb'\"{\\" {') == (1, 1, 1)
    effect = dict(outer_delta=1, outer_least=0, inner_delta=0, inner_least=0)
    blocks = [
        dict(file="f", block=0, flips=1, **effect),
        dict(file="f", block=9, flips=1, outer_delta=5, outer_least=0, inner_delta=0, inner_least=-1),
        dict(file="f", block=20, flips=0, outer_delta=-2, outer_least=-2, inner_delta=9, inner_least=0),
    ]
    starts = scan_blocks(blocks[::-1])
    assert [(s.depth, s.inside, s.owner, s.first, s.last) for s in starts.values()] == [
        (0, False, 0, True, False), (1, True, 0, False, False), (1, False, 1, False, True)
    ]
    with pytest.raises(ValueError):
        scan_blocks(blocks[:2])
    cut = list(_cut_block(iter([b'x"', b', {"b": 2']), _Start(4, 1, True, 2, False, False), "f"))
    assert cut == [(2, 4, 0, False, b'x"}'), (4, 4, 1, True, b'{"b": 2}')]
