import pytest

from llm_helpers import ODD, components, docs, edited, frame, generator, prose, shingle_set
from sqlgauge.llm import minhash as M


def expected(texts, size, percent=80):
    sets = [shingle_set(t, size) for t in texts]
    links = [
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return components(len(texts), links), [len(s) for s in sets]


def corpus(seed=3):
    rng = generator(seed)
    bases = [prose(rng, n) for n in (5, 30, 80, 300)]
    texts = [*ODD, *bases]
    for base in bases:
        texts += [base, base.upper()]
        texts += [edited(rng, base, rng.randrange(1, 2 + len(base.split()) // 18)) for _ in range(12)]
    return texts + [prose(rng, 50) for _ in range(20)]


@pytest.mark.parametrize("hubs, tile", [(3, 512), (1, 4)])
def test_components_match_brute_force(spark, monkeypatch, hubs, tile):
    monkeypatch.setattr(M, "HUBS", hubs)
    monkeypatch.setattr(M, "TILE", tile)
    texts = corpus()
    got = M.near_duplicates(docs(spark, texts), shingle=4).collect()
    names, sizes = expected(texts, 4)
    assert len(got) == len(texts)
    for r in got:
        assert (r.component_id, r.n_shingles) == (names[r.doc_id], sizes[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)


def test_null_ids_repeated_rows_and_nothing(spark):
    text = "the same words in a row for everyone here"
    rows = [(None, text, "a"), (7, text, "a"), (7, text, "a"), (9, text + " now", None), (3, None, "a")]
    found = M.near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in found) == [
        ("3", "3", True), ("7", "7", True), ("7", "7", True),
        ("9", "7", False), ("None", "7", False),
    ]
    assert M.near_duplicates(frame(spark, []).where("false")).count() == 0
    alone = M.near_duplicates(frame(spark, [(None, text, "a")])).first()
    assert alone.component_id is None and alone.kept


def test_filter_keeps_one_row_and_all_columns(spark):
    rng = generator(5)
    base = prose(rng, 100)
    rows = [(5, base, "a"), (2, edited(rng, base, 1), "b"), (2, base, "c"), (8, None, None), (8, None, None)]
    given = frame(spark, rows)
    left = M.drop_near_duplicates(given)
    assert left.columns == given.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 8]
    assert M.drop_near_duplicates(given.where("false")).count() == 0
