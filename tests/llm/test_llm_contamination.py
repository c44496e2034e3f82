import numpy as np
import pytest

from llm_helpers import ODD, docs, edited, frame, generator, prose
from sqlgauge.llm import contamination as C


def plain_score(item, text):
    best, above = 0, [0] * (len(text) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(text):
            row.append(max(0, above[j] + (1 if a == b else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def test_alignment_matches_plain_recursion():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item, text = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 25))
        score, i, j = C.align(item, text)
        assert score == plain_score(item.tolist(), text.tolist())
        assert 0 <= i <= len(item) and 0 <= j <= len(text)


@pytest.mark.parametrize("block_words", [500_000, 60])
def test_whole_and_edited_items_are_found(spark, monkeypatch, block_words):
    monkeypatch.setattr(C, "BLOCK_WORDS", block_words)
    rng = generator(4)
    items = [prose(rng, rng.randrange(20, 50), 300) for _ in range(8)]
    texts, truth = list(ODD), set()
    for number, item in enumerate(items):
        for text in (item, item.upper(), item.replace(" ", " , "), edited(rng, item, len(item.split()) // 8)):
            truth.add((len(texts), number))
            texts.append(f"{prose(rng, 60, 300)} {text} {prose(rng, 60, 300)}")
    texts += [prose(rng, 200, 300) for _ in range(30)]
    texts += [items[0]] * 40  # an item in most documents
    truth |= {(len(texts) - 1 - k, 0) for k in range(40)}
    benchmark = spark.createDataFrame(
        [*enumerate(items), (90, None), (None, "x y z"), (91, "a b"), (92, "")],
        "item_id bigint, text string",
    )
    given = docs(spark, texts)
    found = C.find_leaks(given, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == truth
    for r in found:
        assert r.similarity >= 0.5 and r.start < r.end
    left = C.drop_contaminated(given, benchmark)
    assert left.columns == given.columns
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {d for d, _ in truth}


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    given = frame(spark, [(None, "a b c d e f g h i", "s"), (1, None, None)])
    assert C.find_leaks(given, empty).count() == 0
    assert C.drop_contaminated(given, empty).count() == 2
    one = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id bigint, text string")
    assert [r.doc_id for r in C.find_leaks(given, one).collect()] == [None]
    assert [r.doc_id for r in C.drop_contaminated(given, one).collect()] == [1]
    assert C.find_leaks(given.where("false"), one).count() == 0


def test_scores_match_alignment_of_all_pairs(spark):
    rng = generator(12)
    items = [prose(rng, rng.randrange(18, 40), 250) for _ in range(6)]
    texts = [None, "", prose(rng, 150, 250)]
    for item in items:
        n = len(item.split())
        for change in (item, edited(rng, item, n // 8), edited(rng, item, n // 6), " ".join(item.split()[: n // 3]),
                       " ".join(item.split()[: n // 2] + ["new", "words"] + item.split()[n // 2 :])):
            texts.append(f"{prose(rng, 40, 250)} {change} {prose(rng, 40, 250)}")
    texts += [prose(rng, 120, 250) for _ in range(10)]
    want = {}
    for d, text in enumerate(texts):
        for k, item in enumerate(items):
            score = plain_score(item.split(), (text or "").split())
            if score >= C.needed_score(len(item.split()), 0.5):
                want[d, k] = score
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r.score for r in C.find_leaks(docs(spark, texts), benchmark).collect()}
    assert found == want and len(want) >= 20
