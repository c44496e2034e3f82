import itertools

import numpy as np
import pyarrow as pa

from llm_helpers import ODD, frame, generator, prose
from sqlgauge.llm import toxicity as X
from sqlgauge.llm.words import column_bytes


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    field = X.Field(np.zeros(1), 0.0, rng.normal(size=(2, 2)), np.zeros(3))
    of = np.array([0, 1, 1, 5, 12])
    emission = rng.normal(size=12)
    got = field.marginals(emission, of)
    for a, b in zip(of[:-1], of[1:], strict=True):
        total, ones = 0.0, np.zeros(b - a)
        for labels in itertools.product((0, 1), repeat=int(b - a)):
            score = sum(emission[a + i] for i, y in enumerate(labels) if y)
            score += sum(field.moves[x, y] for x, y in zip(labels, labels[1:]))
            total += np.exp(score)
            ones += np.exp(score) * np.array(labels, dtype=float)
        if b > a:
            assert np.allclose(got[a:b], ones / total)


def labelled(n=900, seed=1):
    rng = generator(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randrange(20, 60)).split()
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), f"vile{rng.choice('abcdefghij')}{rng.choice('xyz')}")
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic), 1))
    return rows, labels


LABELS = "doc_id bigint, toxic int, quality int"


def test_held_out_documents_and_spans(spark):
    rows, labels = labelled()
    odd = [(10_000 + i, t, None) for i, t in enumerate(ODD)]
    found = X.classify(frame(spark, rows + odd), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(rows) + len(odd)
    truth = dict((i, y) for i, y, _ in labels)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert len(held) > 100 and right >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    text = dict((i, t) for i, t, _ in rows)
    spans = [text[r.doc_id][s.start : s.end] for r in found if r.doc_id in text for s in r.spans]
    assert spans and sum(s.startswith("vile") for s in spans) >= 0.98 * len(spans)
    assert all(r.predicted == 0 for r in found if r.doc_id >= 10_000)
    clean = X.drop_toxic(frame(spark, rows), spark.createDataFrame(labels, LABELS))
    assert clean.columns == frame(spark, rows).columns
    assert abs(clean.count() - (len(rows) - sum(truth.values()))) <= 15


def test_without_labels_rows_or_both_classes(spark):
    rows, _ = labelled(20)
    nothing = spark.createDataFrame([], LABELS)
    assert all(r.predicted == 0 for r in X.classify(frame(spark, rows), nothing).collect())
    odd = spark.createDataFrame([(1, 1, 1), (2, None, 0), (None, 1, 1), (3, 5, 1)], LABELS)
    assert X.classify(frame(spark, [(None, None, None), *rows]), odd).count() == 21
    assert X.classify(frame(spark, rows).where("false"), odd).count() == 0


def test_spans_count_code_points():
    raw, bounds = column_bytes(pa.array(["é😀 bad, x", "bad"]))
    starts, _, of = X.word_forms(raw, bounds)
    marginal = np.array([0.1, 0.9, 0.1, 0.8])
    spans = X._spans(raw, bounds, starts, of, marginal)
    assert [(s["start"], s["end"]) for row in spans for s in row] == [(3, 6), (0, 3)]


def test_one_id_in_a_third_of_all_rows(spark):
    rows, labels = labelled(400)
    rng = generator(6)
    rows += [(0, f"{prose(rng, 40)} vilea", "s") for _ in range(150)] + [rows[5]] * 150
    rows += [(7, "vilex " * 40_000, "s")]  # too long to take part
    frame_ = frame(spark, rows, 8)
    truth = {i: y for i, y, _ in labels}
    found = X.classify(frame_, spark.createDataFrame(labels, LABELS), fit_documents=300).collect()
    assert len(found) == len(rows)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
