import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_helpers import generator, prose
from sqlgauge.llm import divergence
from sqlgauge.llm.divergence import joint_values, source_divergence, terms

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n int, rank int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def frame(spark, rows, partitions=3):
    full = [(i, t, lang, s, "t", 1, 2) for i, (t, lang, s) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def expected(rows, least=10, top=10):
    rows = [(t, lang or "", s or "") for t, lang, s in rows]
    held, uses = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for text, lang, source in rows:
        groups[lang].add(source)
        uses[lang, source].update(words(text))
        held[lang].update(set(words(text)))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        whole = sum((uses[lang, s] for s in sources), Counter())

        def prices(counted, kept=kept):
            total = sum(counted[t] for t in kept)
            return {t: 1 + 10**9 * (counted[t] + 2) // (total + 2 * len(kept)) for t in kept}

        by = {s: prices(uses[lang, s]) for s in sources}
        usual = prices(whole)

        def far(p, q):
            return (p - q) ** 2 // (p + q)

        for s in sources:
            pairs = [(-sum(far(by[s][t], by[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            found = [
                (-far(by[s][t], usual[t]), t.encode())
                for t in kept
                if uses[lang, s][t] and by[s][t] > usual[t]
            ]
            for part, items, most in (("pair", pairs, None), ("term", found, top)):
                for rank, (value, item) in enumerate(sorted(items)[:most], 1):
                    out.add((lang, s, part, item.decode(), -value, rank))
    return out


def corpus(rng, n=150):
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", None, "xx"])
        text = prose(rng, rng.randrange(60), 40).replace("w", rng.choice(["w", "W", "é", "-q"]))
        text = re.sub("[0-9]", lambda m: "abcdefghij"[int(m.group())], text)
        rows.append((text, lang, rng.choice(["hot", "hot", "b", "ü", "", None]) if lang != "xx" else "only"))
    return rows


@pytest.mark.parametrize("cells", [1 << 18, 64])
def test_matches_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
    rows = corpus(generator(cells))
    rows += [(None, "en", "b"), ("", "de", "empty"), ("12 34 !", "de", "empty"), (None, None, None)]
    rows += [("Only ten", "few", f"s{i % 2}") for i in range(9)] + [rows[0]] * 12
    found = source_divergence(frame(spark, rows)).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == expected(rows)


def test_long_texts_count_their_terms_once(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_STRETCH", 50)
    long_ = " ".join(["Aa", "bb", "cc", "é" * 40] * 40)
    counted = list(terms(long_.encode()))
    assert len(counted) > 10 and sum(counted, []) == [w.encode() for w in words(long_)]
    counted = list(terms(b"x" * 130 + b" y"))
    assert counted == [[b"x" * 130], [b"y"]]


def test_a_text_of_several_stretches(spark):
    long_ = "Alpha beta, " * 500_000  # six million bytes
    rows = [(long_, "en", "a"), ("alpha", "en", "a"), ("beta gamma", "en", "b")]
    rows += [("alpha gamma", "en", "b")] * 8
    found = {tuple(r) for r in source_divergence(frame(spark, rows)).collect()}
    assert found == expected(rows)


def test_empty_table_and_nulls_only(spark):
    assert source_divergence(frame(spark, [("a", "b", "c")]).where("doc_id > 5")).count() == 0
    rows = [(None, None, None), (None, None, "s")]
    assert {tuple(r) for r in source_divergence(frame(spark, rows)).collect()} == expected(rows)


@pytest.mark.parametrize("columns", [4096, 12])
def test_joint_values_match_a_plain_sum(monkeypatch, columns):
    monkeypatch.setattr(divergence, "MOST_COLUMNS", columns)
    monkeypatch.setattr(divergence, "TILE", 5)
    rng = np.random.default_rng(columns)
    n, groups = 60, 6
    zero = rng.integers(1, 1000, groups)
    price = np.tile(zero, (n, 1))
    term, group = np.nonzero(rng.random((n, groups)) < 0.4)
    price[term, group] = rng.integers(1000, 10**9, len(term))
    price[term[::3], group[::3]] = 5000
    p, q = price[:, :, None], price[:, None, :]
    wanted = ((p - q) ** 2 // (p + q)).sum(axis=0)
    order = rng.permutation(len(term))
    found = joint_values(term[order], group[order], price[term, group][order], n, zero)
    assert (found == wanted).all()
    assert (joint_values(np.empty(0, int), np.empty(0, int), np.empty(0, int), 0, zero) == 0).all()
