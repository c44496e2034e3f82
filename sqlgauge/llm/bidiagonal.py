"""Singular values and right singular vectors of a triangular matrix by qd recurrences."""

from __future__ import annotations

import math

import numpy as np

_EPS = float(np.finfo(float).eps)
# An off-diagonal entry of the squared matrix this small, relatively, counts as 0.
_NEGLIGIBLE = (16 * _EPS) ** 2
_TINY = 1e-290
# Eigenvalues closer than this, relatively, get their vectors together.
_CLUSTER = 1e-8


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """``v, beta, alpha`` such that ``x - beta * v * (v @ x)`` is ``alpha`` and zeros."""
    if len(x) < 2 or not x[1:].any():
        return np.zeros(len(x)), 0.0, float(x[0])
    alpha = -math.copysign(float(np.linalg.norm(x)), float(x[0]))
    v = x.copy()
    v[0] -= alpha
    return v, 2.0 / float(v @ v), alpha


class Bidiagonal:
    """A square matrix as ``U B V'``: the two diagonals of B and the reflectors of V."""

    def __init__(self, matrix: np.ndarray):
        a = np.array(matrix, dtype=float)
        width = a.shape[1]
        self.diagonal, self.above = np.zeros(width), np.zeros(max(0, width - 1))
        self.reflectors: list[tuple[int, np.ndarray, float]] = []
        for k in range(width):
            v, beta, self.diagonal[k] = _reflector(a[k:, k])
            if beta:
                a[k:, k:] -= np.outer(beta * v, v @ a[k:, k:])
            if k + 1 < width:
                v, beta, self.above[k] = _reflector(a[k, k + 1 :])
                if beta:
                    a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, beta * v)
                    self.reflectors.append((k + 1, v, beta))

    def back(self, vectors: np.ndarray) -> np.ndarray:
        """Columns given in the basis of B, in the basis of the matrix."""
        out = vectors.copy()
        for start, v, beta in reversed(self.reflectors):
            out[start:] -= np.outer(beta * v, v @ out[start:])
        return out


def _shifted(q: list[float], e: list[float], shift: float) -> tuple[list, list] | None:
    """One dqds step; None when the shift was above the smallest eigenvalue."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    for k in range(n - 1):
        if d < 0:
            return None
        total = d + e[k]
        new_q[k] = total
        if total > _TINY:
            ratio = q[k + 1] / total
            new_e[k] = e[k] * ratio
            d = d * ratio - shift
        else:
            new_e[k], d = 0.0, q[k + 1] - shift
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e


def _trailing(q: list[float], e: list[float]) -> float:
    """Smaller eigenvalue of the last two rows, a guess at the smallest of all."""
    a, b, off = q[-2], q[-1] + e[-1], q[-2] * e[-1]
    half = (a - b) / 2
    root = math.sqrt(half * half + off)
    high = (a + b) / 2 + root
    return max(0.0, a * q[-1] / high) if high > 0 else 0.0


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling (dqds).

    The recurrences neither subtract except for the shifts nor form products of the
    matrix, so small values are as accurate, relatively, as large ones.
    """
    scale = max(float(np.abs(diagonal).max(initial=0.0)), float(np.abs(above).max(initial=0.0)))
    if scale == 0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    waiting = [(((diagonal / scale) ** 2).tolist(), ((above / scale) ** 2).tolist(), 0.0)]
    while waiting:
        q, e, moved = waiting.pop()
        steps = 0
        while q:
            n = len(q)
            if n == 1 or e[-1] <= _NEGLIGIBLE * (moved + q[-1]) or e[-1] < _TINY:
                found.append(moved + q.pop())
                if e:
                    e.pop()
                steps = 0
                continue
            cut = next(
                (
                    k
                    for k in range(n - 2, -1, -1)
                    if e[k] <= _NEGLIGIBLE * (moved + min(q[k], q[k + 1])) or e[k] < _TINY
                ),
                None,
            )
            if cut is not None:
                waiting.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < q[-1]:
                q, e = _flipped(q, e)
            steps += 1
            if steps > 60 * n:
                raise ArithmeticError("the qd iteration did not settle")
            guess = _trailing(q, e) if steps > 1 else 0.0
            for shift in (guess, 0.9 * guess, 0.5 * guess, 0.0):
                moved_on = _shifted(q, e, shift)
                if moved_on is not None:
                    q, e = moved_on
                    moved += shift
                    break
    return np.sort(np.array(found))[::-1] * scale * scale


def _flipped(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The qd array of the matrix turned upside down, with the same eigenvalues."""
    return q[::-1], e[::-1]


def _twisted(d: np.ndarray, e: np.ndarray, value: float) -> np.ndarray:
    """Eigenvector of ``B'B`` for ``value`` from its twisted factorisation.

    The factorisations from the top and from the bottom meet in the row whose pivot is
    smallest; there the vector is 1, and the multipliers of both give the rest.
    """
    n = len(d)
    floor = _EPS * _EPS * max(float((d * d).max()), _TINY)
    squares, ratio = (d * d).tolist(), (e / d[:-1]).tolist()
    down, top, s = [0.0] * (n - 1), [0.0] * n, -value
    for k in range(n - 1):
        top[k] = s
        pivot = squares[k] + s
        pivot = pivot if abs(pivot) > floor else math.copysign(floor, pivot)
        down[k] = squares[k] * ratio[k] / pivot
        s = down[k] * ratio[k] * s - value
    top[n - 1] = s
    up, bottom, p = [0.0] * (n - 1), [0.0] * n, squares[n - 1] - value
    for k in range(n - 2, -1, -1):
        bottom[k + 1] = p
        pivot = squares[k] * ratio[k] * ratio[k] + p
        pivot = pivot if abs(pivot) > floor else math.copysign(floor, pivot)
        up[k] = squares[k] * ratio[k] / pivot
        p = p * squares[k] / pivot - value
    bottom[0] = p
    twist = min(range(n), key=lambda k: abs(top[k] + bottom[k] + value))
    z = [0.0] * n
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(twist, n - 1):
        z[k + 1] = -up[k] * z[k]
    out = np.array(z)
    out = np.where(np.isfinite(out), out, 0.0)
    return out / np.linalg.norm(out)


def _together(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal vectors for eigenvalues that are as good as equal."""
    n = len(d)
    square = np.diag(d * d) + np.diag(d[:-1] * e, 1) + np.diag(d[:-1] * e, -1)
    square[np.arange(1, n), np.arange(1, n)] += e * e
    size = max(float(np.abs(square).max()), _TINY)
    moved = square - (float(values.mean()) + 4 * _EPS * size) * np.eye(n)
    z = np.random.default_rng(n).normal(size=(n, len(values)))
    for _ in range(4):
        z = np.linalg.qr(np.linalg.solve(moved, z))[0]
    # Turned so that they answer to the eigenvalues in their order.
    inner = np.linalg.eigh(z.T @ square @ z)[1][:, ::-1]
    return z @ inner


def leading_vectors(bidiagonal: Bidiagonal, values: np.ndarray, count: int) -> np.ndarray:
    """Right singular vectors of the first ``count`` squared singular values, as rows.

    The coordinate of largest size is positive.
    """
    d, e = bidiagonal.diagonal.copy(), bidiagonal.above
    size = max(float(np.abs(d).max(initial=0.0)), float(np.abs(e).max(initial=0.0)), _TINY)
    d[np.abs(d) < _EPS * size * 1e-3] = _EPS * size * 1e-3
    found: list[np.ndarray] = []
    at = 0
    while at < min(count, len(values)):
        end = at + 1
        while end < len(values) and values[end - 1] - values[end] <= _CLUSTER * values[end - 1]:
            end += 1
        if end == at + 1:
            found.append(_twisted(d, e, float(values[at]))[:, None])
        else:
            found.append(_together(d, e, values[at:end]))
        at = end
    basis = bidiagonal.back(np.hstack(found)[:, :count])
    basis, triangle = np.linalg.qr(basis)
    basis = basis * np.where(np.diag(triangle) < 0, -1.0, 1.0)
    largest = np.abs(basis).argmax(axis=0)
    return (basis * np.where(basis[largest, np.arange(basis.shape[1])] < 0, -1.0, 1.0)).T
