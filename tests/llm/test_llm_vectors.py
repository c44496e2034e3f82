import math

import numpy as np
import pytest

from llm_helpers import components
from sqlgauge.llm.vectors import near_vectors


def rows_of(seed=3, n=400, width=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width))
    base[50:90] = base[50] + rng.normal(scale=0.15, size=(40, width))
    base[100:130] = 3 * base[100]
    base[130:190:2] = base[131:191:2] + rng.normal(scale=0.08, size=(30, width))
    return base.astype(np.float32)


def check(found, vectors, n):
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    names = components(len(vectors), np.argwhere(close).tolist())
    for r in found:
        if r.vec_id < len(vectors):
            assert (r.n_links, r.component_id) == (close[r.vec_id].sum(), names[r.vec_id])
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert len(found) == n


@pytest.mark.parametrize("block", [8192, 37])
def test_links_match_brute_force(spark, block):
    vectors = rows_of()
    width = vectors.shape[1]
    odd = [None, [0.0] * width, [math.nan] * width, [math.inf] * width, [1.0] * 3, [],
           [None] + [1.0] * (width - 1)]
    rows = [(i, v.tolist(), 1, "n") for i, v in enumerate(vectors)]
    rows += [(1000 + i, v, 2, "m") for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, block string")
    check(near_vectors(df.repartition(5), block=block).collect(), vectors, len(rows))


def test_nothing_nulls_and_one(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0
    odd = near_vectors(spark.createDataFrame([(1, None), (None, [1.0, 0.0])], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links) for r in odd) == [("1", 0), ("None", 0)]
    pair = near_vectors(spark.createDataFrame([(4, [1.0]), (2, [5.0]), (3, [-1.0])], schema))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in pair.collect()) == [
        (2, 1, 2), (3, 0, 3), (4, 1, 2)
    ]


def test_widths_copies_and_repeated_ids(spark):
    rng = np.random.default_rng(9)
    wide = [(i, rng.normal(size=3).tolist()) for i in range(10)]
    rare = [(20, [1.0, 2.0]), (21, [2.0, 4.0]), (22, [-1.0, 2.0]), (23, [5.0]), (24, [9.0])]
    copies = [(100 + i, [0.0, 0.0, 1.0, 0.0]) for i in range(300)] + [(99, [0.0, 0.02, 1.0, 0.0])]
    ids = [(500, [1.0, 0.0, 0.0, 0.0, 0.0]), (500, [0.0, 1.0, 0.0, 0.0, 0.0]),
           (501, [1.0, 0.1, 0.0, 0.0, 0.0]), (502, [0.1, 1.0, 0.0, 0.0, 0.0]), (501, [1.0, 0.1, 0.0, 0.0, 0.0])]
    schema = "vec_id bigint, embedding array<double>"
    df = spark.createDataFrame(wide + rare + copies + ids, schema).repartition(4)
    found = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, block=64).collect()}
    assert (found[20], found[21], found[22]) == ((1, 20), (1, 20), (0, 22))
    assert (found[23], found[24]) == ((1, 23), (1, 23))
    assert found[99] == (300, 99) and {found[100 + i] for i in range(300)} == {(300, 99)}
    # The two vectors of 500 have three links; the copies of 501 have each other's too.
    assert (found[500], found[501], found[502]) == ((3, 500), (4, 500), (1, 500))


def test_a_block_of_close_vectors_is_compared_in_bounded_memory():
    import tracemalloc

    import pandas as pd

    from sqlgauge.llm.vectors import _compare

    rng = np.random.default_rng(4)
    unit = np.ones((3000, 16)) + rng.normal(scale=0.01, size=(3000, 16))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    unit = unit[np.argsort(unit[:, 0])]
    rows = pd.DataFrame({"cls": np.arange(3000), "weight": 2, "block": 0, "axis": unit[:, 0], "unit": list(unit)})
    tracemalloc.start()
    found = _compare(0.9)((), rows)
    assert tracemalloc.get_traced_memory()[1] < 80_000_000
    tracemalloc.stop()
    assert (found["n"] == 2 * 2999).all() and (found["root"] == 0).all()
