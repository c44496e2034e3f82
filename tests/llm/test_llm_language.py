import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from conftest import SF
from llm_helpers import generator
from sqlgauge.llm import language
from sqlgauge.llm.language import (
    LETTERS, SIZE, _vote, families_of, features, fit_languages, identify_languages,
)
from sqlgauge.llm.words import segments

SCHEMA = "doc_id bigint, text string, lang string, source string, lettered string, score int"
# Two pairs of related languages: each pair shares its syllables and differs in endings.
SYLLABLES = {
    "aa": (["ka", "lo", "mi", "su"], ["en", "en", "ung"]),
    "ab": (["ka", "lo", "mi", "su"], ["ar", "as", "os"]),
    "ba": (["thr", "øk", "blu", "sny"], ["ing", "ed", "ly"]),
    "bb": (["thr", "øk", "blu", "sny"], ["ité", "eux", "ette"]),
}


def sentence(rng, lang, n):
    stems, ends = SYLLABLES[lang]
    return " ".join(
        "".join(rng.choice(stems) for _ in range(rng.randrange(1, 3))) + rng.choice(ends)
        for _ in range(n)
    )


def frame(spark, rows, partitions=3):
    full = [(i, t, lang, "s", "l", 1) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def corpus(n=240, seed=5):
    rng = generator(seed)
    return [(i, sentence(rng, lang, rng.randrange(3, 40)), lang)
            for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(n))]


def test_families_and_accuracy(spark):
    rows = corpus()
    found = {r.doc_id: r for r in identify_languages(frame(spark, rows)).collect()}
    assert len(found) == len(rows)
    right = [found[i].lang_pred == lang for i, _, lang in rows if found[i].held_out]
    assert len(right) > 40 and np.mean(right) > 0.97
    assert all(found[i].held_out == held(i) and 0 <= found[i].score <= 1 for i, _, _ in rows)
    model = fit_languages([t for _, t, _ in rows], [lang for _, _, lang in rows])
    assert model.families == [[0, 1], [2, 3]]
    assert [p.shape[1] for p in model.pairs] == [1, 1]


def test_held_out_labels_are_never_used(spark):
    rows = corpus()
    wrong = [(i, t, "zz" if held(i) else lang) for i, t, lang in rows]
    a = sorted(identify_languages(frame(spark, rows)).collect())
    assert a == sorted(identify_languages(frame(spark, wrong, 5)).collect())


def test_given_documents():
    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    train = [r for r in table if not held(r["doc_id"])]
    model = fit_languages([r["text"] for r in train], [r["lang"] for r in train])
    rest = [r for r in table if held(r["doc_id"])]
    number, score = model.predict(pa.array([r["text"] for r in rest]))
    right = [model.names[k] == r["lang"] for k, r in zip(number, rest, strict=True)]
    assert np.mean(right) >= 0.95 and score.min() >= 0 and score.max() <= 1


def test_odd_rows(spark):
    rows = corpus(120)
    odd = [None, "", "   ", "123 €€ !?", "\n\n", "kalo" * 200_000, "KALOEN MISUUNG", "é"]
    rows += [(1000 + k, t, None) for k, t in enumerate(odd)] + [(None, "misuen", "aa")]
    rows += [rows[0]] * 3 + [(2000, "word", "")]
    found = {}
    for r in identify_languages(frame(spark, rows)).collect():
        assert found.setdefault(r.doc_id, r) == r
    assert {found[1000 + k].lang_pred for k in range(5)} == {"und"}
    assert all(found[1000 + k].score == 0 for k in range(5))
    assert found[1006].lang_pred == "aa" and found[None].held_out is False
    assert {found[i].lang_pred for i in (1005, 1007)} <= {*SYLLABLES, ""}


def test_one_text_in_a_third_of_all_rows(spark):
    rows = corpus(200) + [(0, "kaloen misuung " * 50, "aa")] * 100
    found = identify_languages(frame(spark, rows), fit_documents=20).collect()
    right = [r.lang_pred == lang for r, lang in
             ((r, dict((i, x) for i, _, x in rows)[r.doc_id]) for r in found) if r.held_out]
    assert len(found) == 300 and np.mean(right) > 0.9


def test_nothing_learnt(spark):
    docs = frame(spark, [(1, "some words", None), (2, None, "en")])
    assert sorted((r.lang_pred, r.score) for r in identify_languages(docs).collect()) == [
        ("und", 0.0), ("und", 0.0)
    ]
    assert identify_languages(docs.where("doc_id > 7")).count() == 0
    one = frame(spark, [(i, "some words", "en") for i in range(8)])
    assert {r.lang_pred for r in identify_languages(one).collect()} == {"en"}


def _plain_features(text):
    raw = [int(LETTERS[b]) for b in text.encode()]
    padded = [0, 0, *raw, 0, 0, 0]
    mod, odd = 1 << 64, [int(x) for x in language._ODD]
    out = []
    for i in range(2, 2 + len(raw)):
        if padded[i]:
            g = sum(v * f for v, f in zip(padded[i - 1 : i + 2], odd[:3], strict=True))
            out.append((0, g * odd[7] % mod >> 50))
            ahead = padded[i + 2] if padded[i + 1] else 0
            out.append((1, (g + ahead * odd[3]) * odd[7] % mod >> 50))
    return sorted(t << 14 | b for t, b in out)


def test_features_do_not_cross_texts():
    texts = ["ab", "", "c", "Ünd so-weiter 12x", "  "]
    data = [t.encode() for t in texts]
    raw = np.frombuffer(b"".join(data), np.uint8)
    bounds = np.cumsum([0, *map(len, data)])
    found = features(raw, bounds)
    for row, text in enumerate(texts):
        codes = np.concatenate([b[of[row] : of[row + 1]] for b, of in found[:2]])
        assert sorted(codes.tolist()) == _plain_features(text)
    assert np.diff(found[2][1]).tolist() == [1, 0, 1, 4, 0]


def test_long_texts_come_in_segments():
    rng = generator(3)
    texts = [sentence(rng, "aa", 400), None, "x" * 700, sentence(rng, "bb", 3), "", " "]
    seen = [b""] * len(texts)
    for raw, bounds, rows in segments(pa.array(texts), LETTERS, 300):
        for k, row in enumerate(rows.tolist()):
            seen[row] += raw[bounds[k] : bounds[k + 1]].tobytes()
    assert seen == [(t or "").encode() for t in texts]
    rows = corpus(80)
    model = fit_languages([t for _, t, _ in rows], [lang for _, _, lang in rows])
    column = pa.array([sentence(rng, lang, 300) for lang in SYLLABLES])
    whole = model.predict(column)
    original = language.segments
    language.segments = lambda column, values: original(column, values, 200)
    try:
        cut = model.predict(column)
    finally:
        language.segments = original
    assert whole[0].tolist() == cut[0].tolist() and np.allclose(whole[1], cut[1])


def test_votes():
    margin = np.array([[1.0, 1, 1], [-1, -1, 2], [-1, -1, -2], [1, -2, 0.5]])
    winner, least = _vote(margin, 3)
    assert winner[:3].tolist() == [0, 1, 2] and least[:3].tolist() == [1, 1, 1]
    # Each of three wins one duel: the sums decide.
    assert winner[3] == 2 and len(list(combinations(range(3), 2))) == 3


@pytest.mark.parametrize("n", [1, 2, 5])
def test_family_sizes(n):
    groups = families_of(np.random.default_rng(n).random((n, 30)))
    assert sorted(sum(groups, [])) == list(range(n))
    assert len(groups) == int(np.ceil(np.sqrt(n))) and SIZE == 3 << 14
