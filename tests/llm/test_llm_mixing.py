import numpy as np
import pytest

from llm_helpers import ODD, frame, generator, prose
from sqlgauge.llm import mixing as M


def water(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        level = rest / free if free else 0
        more = {s for s in names if s not in capped and level * weight[s] > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= more


def corpus(n=1500):
    rng = generator(6)
    sources = ["a"] * 6 + ["b", "b", "é", None, "zz"]
    rows = [(i, prose(rng, rng.randrange(1, 80)), rng.choice(sources)) for i in range(n)]
    return rows + [(n + i, t, "odd") for i, t in enumerate(ODD)]


@pytest.mark.parametrize("chunk", [4096, 40])
def test_targets_are_met_and_reruns_agree(spark, monkeypatch, chunk):
    monkeypatch.setattr(M.balanced_choice, "__defaults__", (7, chunk))
    rows = corpus()
    found = M.mix_sources(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = water(sizes)
    for source in sizes:
        mine = [r for r in found if r.source == source]
        assert all(r.source_size == sizes[source] for r in mine)
        assert all(abs(r.target - want[source]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - want[source]) <= 85
        assert all(r.taken == r.size * r.copies and 0 <= r.copies <= 2 for r in mine)
    again = M.mix_sources(frame(spark, rows[::-1], 5)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in found)


def test_flight_keeps_sums_and_leaves_two():
    rng = np.random.default_rng(1)
    for loads in (rng.integers(1, 500, 300).astype(float), np.full(300, 7.0), np.zeros(300)):
        chance = rng.random(300)
        flown = M.cube_flight(chance, loads, np.random.default_rng(2))
        assert ((flown > 0) & (flown < 1)).sum() <= 2
        assert abs(flown.sum() - chance.sum()) < 1e-6
        assert abs(flown @ loads - chance @ loads) < 1e-4


def test_inclusion_chances_hold_on_average():
    chance, loads = np.array([0.2, 0.5, 0.7, 0.9, 0.4]), np.array([3.0, 1.0, 4.0, 1.0, 5.0])
    total = sum(M.cube_flight(chance, loads, np.random.default_rng(s)) for s in range(4000))
    assert np.abs(total / 4000 - chance).max() < 0.04


def test_repeated_rows_nulls_and_nothing(spark):
    rows = [(1, "a b c", "s")] * 5 + [(None, "d e", None), (2, None, "s"), (2, "", "s")]
    given = frame(spark, rows)
    assert M.mix_sources(given).count() == len(rows)
    mixed = M.mixed(given)
    assert mixed.columns == given.columns
    taken = sum(r.copies for r in M.mix_sources(given).collect())
    assert mixed.count() == taken
    assert M.mix_sources(given.where("false")).count() == 0
    assert M.mixed(given.where("text IS NULL")).count() <= 2
