import pytest

from llm_helpers import ODD, docs, frame, generator
from sqlgauge.llm.lines import drop_repeated_lines


def expected(texts, size):
    seen, out = set(), []
    for text in texts:
        lines = [] if text is None else text.split("\n")
        gone = set()
        for i in range(len(lines) - size + 1):
            window = tuple(lines[i : i + size])
            if window in seen:
                gone |= set(range(i, i + size))
            seen.add(window)
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((None if text is None else left, len(lines), len(gone)))
    return out


@pytest.mark.parametrize("size, gram", [(1, 1), (3, 2), (4, 1), (5, 5)])
def test_removed_lines_match_brute_force(spark, size, gram):
    rng = generator(size)
    block = [f"line {rng.randrange(50)}" for _ in range(12)]
    texts = list(ODD)
    for _ in range(60):
        lines = [f"own {rng.randrange(10**6)}" for _ in range(rng.randrange(6))]
        at, n = rng.randrange(12), rng.randrange(10)
        texts.append("\n".join(lines[:2] + block[at : at + n] + lines[2:]))
    texts += ["a\nb\n" * 9, "\n" * 30, texts[30]]
    found = drop_repeated_lines(docs(spark, texts), size, gram).collect()
    want = expected(texts, size)
    assert len(found) == len(texts)
    for r in found:
        assert (r.text, r.n_lines, r.n_removed) == want[r.doc_id]


def test_repeated_rows_null_ids_and_nothing(spark):
    rows = [(1, "a\nb\nc", "s"), (1, "a\nb\nc", "s"), (None, "a\nb\nc", "s"), (2, None, None)]
    found = drop_repeated_lines(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.text), r.n_removed) for r in found) == [
        ("1", "", 3), ("1", "", 3), ("2", "None", 0), ("None", "a\nb\nc", 0),
    ]
    assert drop_repeated_lines(frame(spark, rows).where("false")).count() == 0
    with pytest.raises(ValueError):
        drop_repeated_lines(frame(spark, rows), 2, 3)
