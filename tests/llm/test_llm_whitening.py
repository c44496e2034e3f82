import math

import numpy as np
import pytest

from sqlgauge.llm.bidiagonal import Bidiagonal, leading_vectors, squared_singular_values
from sqlgauge.llm.whitening import Means, _deviations, _reduce, whiten
from sqlgauge.llm import whitening

SCHEMA = "vec_id bigint, embedding array<double>, width string, x int, n int, _v int"


def frame(spark, rows, partitions=3):
    full = [(i, None if v is None else [None if c is None else float(c) for c in v], "w", 1, 2, 3)
            for i, v in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def expected(vectors, count=16):
    """The same by a dense covariance and an eigensolver."""
    x = np.floor(np.asarray(vectors, dtype=float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1][:, :count]
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    return n, deviation, (x - sums / n) @ axes, values[:count], values.sum()


@pytest.mark.parametrize("width", [3, 24])
def test_matches_dense_eigenvectors(spark, monkeypatch, width):
    rng = np.random.default_rng(width)
    vectors = rng.normal(size=(300, width)) * np.linspace(1, 3, width)
    vectors[100:200] = vectors[100]  # a third of all rows are copies
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = whiten(frame(spark, list(enumerate(vectors)), 7)).collect()
    n, deviation, turned, values, total = expected(vectors)
    assert len(rows) == len(vectors) * len(values) and n == 201
    for r in rows:
        at = r.component - 1
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert math.isclose(r.explained, values[at] / total, rel_tol=1e-9)
        assert r.identity_error < 1e-9
        assert math.isclose(
            abs(r.whitened), abs(turned[r.vec_id, at]) / math.sqrt(values[at]), abs_tol=1e-8
        )
    first = {r.vec_id: r.whitened for r in rows if r.component == 1}
    signs = {np.sign(first[i] * turned[i, 0]) for i in range(300) if abs(first[i]) > 1e-6}
    assert len(signs) == 1


def test_odd_rows(spark):
    good = [[1.0, 2.0, 0.5], [0.0, -1.0, 4.0], [2.0, 2.0, 2.0], [1.0, 2.0, 0.5]]
    odd = [None, [], [1.0, None, 2.0], [math.nan] * 3, [math.inf, 0.0, 0.0], [1e30, 0.0, 0.0]]
    rows = [(i, v) for i, v in enumerate(good + odd)] + [(None, good[0]), (0, good[0])]
    rows += [(50, [1.0, 2.0]), (51, [1.0, 4.0]), (52, [7.0])]
    found = whiten(frame(spark, rows)).collect()
    ids = sorted((-1 if r.vec_id is None else r.vec_id) for r in found if r.component == 1)
    assert ids == [-1, 0, 0, 1, 2, 3, 50, 51, 52]
    for r in found:
        if r.width == 3:  # three distinct points span a plane
            assert r.n == 3 and (r.whitened is None) == (r.component == 3)
        if r.width == 2:
            assert r.n == 2 and (r.whitened is None) == (r.component == 2)
        if r.width == 1:
            assert (r.n, r.deviation, r.whitened, r.identity_error) == (1, 0, None, None)
            assert r.explained == 0.0


def test_empty_table(spark):
    assert whiten(frame(spark, [(1, [1.0])]).where("vec_id > 1")).count() == 0


def test_large_numbers_stay_exact():
    means = Means(10**10, [3, -(10**20)])
    x = np.array([[1 << 40, 5], [0, -5]])
    exact = means.times_n(x)
    assert exact[0].tolist() == [10**10 * (1 << 40) - 3, 5 * 10**10 + 10**20]
    assert _deviations(exact).to_pylist() == [None, None]
    near = np.array([[3_037_000_499, 0], [3_037_000_500, 0], [5, 4]])
    assert _deviations(near).to_pylist() == [3_037_000_499**2, None, 41]
    assert _deviations(near.astype(object)).to_pylist() == [3_037_000_499**2, None, 41]


def _matrix(kind, n, rng):
    left, right = (np.linalg.qr(rng.normal(size=(n, n)))[0] for _ in range(2))
    middle = {
        "graded": 10.0 ** -np.linspace(0, 12, n),
        "equal": np.repeat([3.0, 2.0, 1.0], -(-n // 3))[:n],
        "close": 1 + 1e-9 * np.arange(n)[::-1],
        "short": np.where(np.arange(n) < n // 2, 2.0, 0.0),
    }[kind]
    return left @ np.diag(middle) @ right


@pytest.mark.parametrize("kind", ["graded", "equal", "close", "short"])
@pytest.mark.parametrize("n", [2, 7, 40])
def test_solver(kind, n):
    a = _matrix(kind, n, np.random.default_rng(n))
    reduced = Bidiagonal(a)
    values = squared_singular_values(reduced.diagonal, reduced.above)
    wanted = np.linalg.svd(a, compute_uv=False) ** 2
    assert np.allclose(np.sqrt(np.maximum(values, 0)), np.sqrt(wanted), atol=1e-14 * n)
    axes = leading_vectors(reduced, values, 16)
    assert np.allclose(axes @ axes.T, np.eye(len(axes)), atol=1e-13)
    assert np.allclose(a.T @ (a @ axes.T), axes.T * values[: len(axes)], atol=1e-13 * n)


def test_small_singular_values_are_accurate():
    diagonal, above = 10.0 ** -np.arange(0.0, 30, 3), np.full(9, 1e-4) * 10.0 ** -np.arange(0, 27, 3)
    values = squared_singular_values(diagonal, above)
    # The product of all squares is the squared determinant.
    assert math.isclose(np.log(values).sum(), 2 * np.log(diagonal).sum(), rel_tol=1e-13)
    assert values[-1] > 0


def test_zero_matrix_and_stacking():
    reduced = Bidiagonal(np.zeros((4, 4)))
    assert not squared_singular_values(reduced.diagonal, reduced.above).any()
    import pandas as pd

    rng = np.random.default_rng(1)
    blocks = [rng.normal(size=(5, 3)) for _ in range(3)]
    rows = pd.DataFrame({"width": [3] * 3, "node": [0, 1, 2], "_above": [0] * 3, "r": [b.ravel() for b in blocks]})
    r = np.asarray(_reduce(rows)["r"].iloc[0]).reshape(-1, 3)
    stacked = np.vstack(blocks)
    assert np.allclose(r.T @ r, stacked.T @ stacked)
