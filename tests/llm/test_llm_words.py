import numpy as np
import pyarrow as pa
import pytest

from llm_helpers import ODD, generator, prose, shingle_set
from sqlgauge.llm import words as W


def test_words_and_shingles_match_plain_python():
    rng = generator(1)
    texts = [*ODD, *[prose(rng, rng.randrange(60), 9) for _ in range(40)], "A b", "a B"]
    raw, bounds = W.column_bytes(pa.array(texts))
    _, hashes, of = W.words(raw, bounds)
    for size in (1, 2, 4):
        sets = W.shingles(hashes, of, size)
        seen = {}
        for text, found in zip(texts, sets, strict=True):
            plain = shingle_set(text, size)
            assert len(found) == len(plain)
            for other, own in seen.items():
                assert len(np.intersect1d(own, found)) == len(shingle_set(other, size) & plain)
            seen[text or ""] = found


@pytest.mark.parametrize("limit", [1, 7, 60, 10_000])
def test_texts_read_in_segments_have_the_same_shingles(limit):
    rng = generator(2)
    texts = [*ODD, *[prose(rng, rng.choice((0, 1, 3, 4, 5, 90)), 9) for _ in range(40)], "  a  "]
    column = pa.array(["left out", *texts]).slice(1)
    for size in (1, 2, 4):
        raw, bounds = W.column_bytes(column)
        _, hashes, of = W.words(raw, bounds)
        got = []
        for first, sets in W.shingle_sets(column, size, limit):
            assert first == len(got)
            got += sets
        assert len(got) == len(texts)
        for one, other in zip(W.shingles(hashes, of, size), got, strict=True):
            assert np.array_equal(one, other)
    assert list(W.shingle_sets(pa.array([], pa.string()), 4, limit)) == []


def test_slices_and_pieces_cover_everything():
    table = pa.table({"text": ["abc", None, "d" * 50, ""]}).to_batches()[0].slice(1, 3)
    parts = list(W.pieces(table, "text", 10))
    assert sum(p.num_rows for p in parts) == 3
    raw, bounds = W.column_bytes(table.column("text"))
    assert bytes(raw) == b"d" * 50 and bounds.tolist() == [0, 0, 50, 50]


def test_prefixes_are_of_longer_words_only():
    raw, bounds = W.column_bytes(pa.array(["abcd abce ab"]))
    starts, _, _ = W.words(raw, bounds, W.BY_PUNCTUATION)
    three = W.prefixes(raw, starts, (3,), W.BY_PUNCTUATION)[:, 0]
    assert three[0] == three[1] != 0 and three[2] == 0
