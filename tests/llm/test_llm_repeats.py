import numpy as np
import pytest

from llm_helpers import ODD, docs, frame, generator, prose
from sqlgauge.llm import repeats as R


def expected(texts, size, keep_first):
    data = [(t or "").encode() for t in texts]
    places: dict = {}
    for d, b in enumerate(data):
        for i in range(len(b) - size + 1):
            places.setdefault(b[i : i + size], []).append((d, i))
    out = []
    for d, b in enumerate(data):
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - size + 1):
            at = places[b[i : i + size]]
            if len(at) > 1 and (not keep_first or at[0] != (d, i)):
                gone[i : i + size] = True
        out.append(bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def corpus(seed):
    rng = generator(seed)
    passages = [prose(rng, 30, 50) for _ in range(6)]
    texts = list(ODD)
    for _ in range(60):
        parts = [prose(rng, rng.randrange(0, 40)) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(passages)[rng.randrange(20) :])
        parts.insert(0, rng.choice(passages)[: rng.randrange(20, 150)])
        texts.append(" ".join(parts))
    texts += [texts[20], texts[20] + " tail", "ab" * 300, "xyz" * 200, passages[0] * 3, "é" * 90]
    return texts


@pytest.mark.parametrize("size, most", [(40, 4096), (57, 2), (16, 4096)])
@pytest.mark.parametrize("keep_first", [True, False])
def test_removed_bytes_match_brute_force(spark, size, most, keep_first):
    texts = corpus(size)
    got = R.remove_repeats(docs(spark, texts), size, keep_first, most).collect()
    want = expected(texts, size, keep_first)
    assert len(got) == len(texts)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert bytes(r.kept) == want[r.doc_id]
        assert r.n_bytes == len(data)
        assert sum(s.end - s.start for s in r.spans) == len(data) - len(r.kept)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_repeated_rows_null_ids_and_nothing(spark):
    text = "0123456789abcdefghijKLMNOPQRST"
    rows = [(1, text, "a"), (1, text, "a"), (None, text, "b"), (2, None, None)]
    got = R.remove_repeats(frame(spark, rows), 20, keep_first=False).collect()
    assert sorted(len(r.kept) for r in got) == [0, 0, 0, 0]
    assert R.remove_repeats(frame(spark, rows).where("false")).count() == 0
    with pytest.raises(ValueError):
        R.remove_repeats(frame(spark, rows), 8)


SEPARATORS = b" \t\n\v\f\r"


def expected_passages(texts, words, least, cap):
    """Byte ranges of the repeated passages by looking at every separator of every text."""
    data = [(t or "").encode() for t in texts]
    found, holders = [], {}
    for d, b in enumerate(data):
        solid = [c not in SEPARATORS for c in b]
        begins = [i for i in range(len(b)) if solid[i] and (i == 0 or not solid[i - 1])]
        for k, i in enumerate(begins):
            if i:
                end = begins[k + words - 1] if k + words <= len(begins) else len(b) + cap
                while end < len(b) and solid[end]:
                    end += 1
                end = min(end, i - 1 + cap)
                if end <= len(b) and end - i + 1 >= least:
                    found.append((d, i, end))
                    holders.setdefault(b[i - 1 : end], set()).add(b)
    out = [set() for _ in data]
    for d, i, end in found:
        # Equal texts of different ids are different documents.
        held = holders[data[d][i - 1 : end]]
        if len(held) > 1 or data.count(data[d]) > 1:
            out[d] |= set(range(i, end))
    return out


@pytest.mark.parametrize("size, most", [(60, 4096), (60, 2), (35, 4096)])
def test_passages_match_brute_force(spark, size, most):
    rng = generator(size)
    texts = [t and t.replace(" w1", "\n w1") for t in corpus(size)]
    shared = prose(rng, 9, 400)
    texts += [f"{prose(rng, 3)} {shared}", f"{shared}.", f"{prose(rng, 2)} {shared} {prose(rng, 9)}"]
    texts += [f"{prose(rng, 30)} {shared} {prose(rng, 30)} {shared} {prose(rng, 3)}", "a b " * 90]
    got = R.remove_repeats(
        docs(spark, texts), size, False, most, passage_words=6, passage_bytes=24
    ).collect()
    want = expected_passages(texts, 6, 24, size)
    cut = expected(texts, size, False)
    for r in got:
        assert bytes(r.kept) == cut[r.doc_id]
        covered = set()
        for p in r.passages:
            covered |= set(range(p.start, p.end))
        assert covered == want[r.doc_id], r.doc_id
        assert all(a.end < b.start for a, b in zip(r.passages, r.passages[1:]))
    assert sum(map(bool, want)) > 10


def test_repeats_within_one_document_are_no_passages(spark):
    text = prose(generator(1), 60, 500)
    rows = [(1, f"{text} and {text}", "a"), (1, f"{text} and {text}", "a"), (2, "x " * 500, "b")]
    got = R.remove_repeats(frame(spark, rows), keep_first=False).collect()
    assert [len(r.passages) for r in got] == [0, 0, 0]
    rows.append((3, f"Intro {text[:340]} outro", "c"))
    got = {r.doc_id: r for r in R.remove_repeats(frame(spark, rows), keep_first=False).collect()}
    assert (len(got[1].passages), len(got[2].passages), len(got[3].passages)) == (2, 0, 1)
    assert not got[3].spans


def test_parts_of_a_long_text_give_its_stretches():
    import pyarrow as pa

    from sqlgauge.llm.words import overlapping

    rng = generator(8)
    column = pa.array([prose(rng, 700), None, prose(rng, 40), "y" * 3000, prose(rng, 90)])
    rule = R.Rule(60, 6, 24)

    def suffixes(size):
        found, passages = {}, {}
        for raw, bounds, rows, offset, owned, ended in overlapping(column, size, R.STRETCH + 120):
            s = R.stretches(raw, bounds, rule, owned, ended)
            for k in range(len(s["n"])):
                row, at = int(rows[s["row"][k]]), int(s["at"][k]) + offset
                for i in range(int(s["n"][k])):
                    assert found.setdefault((row, at + i), (int(s["least"][k]), i < s["whole"][k])) == (
                        int(s["least"][k]), i < s["whole"][k]
                    )
                if s["p_to"][k] >= 0:
                    passages.setdefault(row, set()).update(
                        range(at + int(s["p_from"][k]), at + int(s["p_to"][k]))
                    )
        return found, passages

    assert suffixes(10**6) == suffixes(900)


def test_strings_of_several_owners():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 99, 300).astype(np.uint8)
    begin = rng.integers(0, 270, 400)
    end = begin + rng.integers(5, 30, 400)
    owner = rng.integers(0, 3, 400)
    strings = [raw[a:b].tobytes() for a, b in zip(begin, end, strict=True)]
    want = [len({o for s, o in zip(strings, owner, strict=True) if s == mine}) > 1 for mine in strings]
    found = R.shared_by_several(*R.string_hashes(raw, begin, end, 5, 30), owner)
    assert found.tolist() == want


def plain_factors(raw, positions, cap):
    def common(a, b):
        n = 0
        while n < cap and a + n < len(raw) and b + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        return n

    return [max([common(p, q) for q in positions[:k]] or [0]) for k, p in enumerate(positions)]


def test_longest_previous_factors():
    rng = np.random.default_rng(0)
    for letters in (1, 2, 3):
        raw = rng.integers(97, 97 + letters, 220).astype(np.uint8)
        positions = np.arange(180)
        suffixes = R.Suffixes(raw, positions, 24)
        common = suffixes.common()
        ordered = [bytes(raw[p : p + 24]) for p in positions[suffixes.order]]
        assert ordered == sorted(ordered)
        got = R.previous_factors(suffixes.order, common, 4)
        for found, want in zip(got, plain_factors(raw, positions.tolist(), 24), strict=True):
            assert found == want or (want < 4 and found <= want)
        mirror = R.next_factors(suffixes.order, common, 4)
        later = plain_factors(raw, positions.tolist()[::-1], 24)[::-1]
        for found, want in zip(mirror, later, strict=True):
            assert found == want or (want < 4 and found <= want)
