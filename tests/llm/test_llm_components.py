import random

import pytest

from llm_helpers import components as expected
from sqlgauge.llm import components as C


def found(spark, links):
    rows = C.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.component for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_links_match_plain_python(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    names = expected(60, links)
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert found(spark, links) == {n: names[n] for n in nodes}


def test_paths_hubs_loops_and_null_ends(spark):
    path = [(n, n + 1) for n in range(100, 140)]
    hub = [(900, n) for n in range(800, 850)]
    odd = [(5, 5), (None, 6), (7, None), (None, None), (31, 30), (30, 31), (31, 30)]
    want = {n: 100 for n in range(100, 141)} | {n: 800 for n in [*range(800, 850), 900]}
    assert found(spark, path + hub + odd) == want | {30: 30, 31: 30}
    assert found(spark, [(1, 1)]) == {}


def test_links_that_are_stars_already_need_no_round(spark, monkeypatch):
    monkeypatch.setattr(C, "_large_star", None)
    assert found(spark, [(1, 2), (3, 1), (8, 9)]) == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
