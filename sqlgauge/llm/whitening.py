"""Whitening directions of integer-scaled vectors, by blockwise QR and a bidiagonal solver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .bidiagonal import Bidiagonal, leading_vectors, squared_singular_values

COMPONENTS = 16
# Entries become ``floor(SCALE * c) + SHIFT``.
SCALE = 64
SHIFT = 1_000_000
# Entries from here on have no 64-bit integer of that kind.
_MOST = float(1 << 56)
# Triangular factors that one task stacks and reduces to one.
FAN = 8
_LIMB = 31


def usable_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, width, x`` of the rows whose entries are all there and finite."""
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.col(vector_column).cast("array<double>").alias("_v"),
    )
    whole = F.forall("_v", lambda c: F.coalesce(F.abs(c) < _MOST, F.lit(False)))
    scaled = F.transform("_v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return rows.where(F.col("_v").isNotNull() & (F.size("_v") > 0) & whole).select(
        "vec_id", F.size("_v").alias("width"), scaled.alias("x")
    )


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Width, row numbers and matrix for each width among the arrays of a batch."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for width in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == width)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield width, rows, flat.reshape(len(rows), width)


def _lists(matrix: np.ndarray) -> pa.Array:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()))


@dataclass
class Means:
    """Number and exact sums of the fit list's vectors of one width."""

    n: int
    sums: list[int]

    def times_n(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact; Python integers where 64 bits could not hold it."""
        most = max(int(np.abs(x).max(initial=0)), 1)
        if self.n * most < 1 << 61 and max(map(abs, self.sums)) < 1 << 61:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def centred(self, exact: np.ndarray) -> np.ndarray:
        return (exact / self.n).astype(np.float64)


def _deviations(exact: np.ndarray) -> pa.Array:
    """Exact sums of squares per row; null where a 64-bit integer cannot hold it."""
    near = (exact.astype(np.float64) ** 2).sum(axis=1)
    if exact.dtype == object:
        totals = [int((row * row).sum()) for row in exact]
        return pa.array([t if t < 1 << 63 else None for t in totals], pa.int64())
    with np.errstate(over="ignore"):
        # Right modulo 2**64, hence right where the true sum is below 2**63.
        totals = (exact * exact).sum(axis=1)
    edge = np.flatnonzero((near > 9.2e18) & (near < 9.25e18))
    wide = near >= 9.25e18
    for row in edge.tolist():
        total = sum(int(v) ** 2 for v in exact[row].tolist())
        wide[row] = total >= 1 << 63
    return pa.array(totals, pa.int64(), mask=wide)


_SUMS = "width int, n long, high array<long>, low array<long>"


def _sum_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per width the number of rows and the sums of the upper and lower bits."""
    found: dict[int, list] = {}
    for batch in batches:
        for width, _, x in _matrices(batch.column("x")):
            total = found.setdefault(width, [0, np.zeros(width, np.int64), np.zeros(width, np.int64)])
            total[0] += len(x)
            total[1] += (x >> _LIMB).sum(axis=0)
            total[2] += (x & ((1 << _LIMB) - 1)).sum(axis=0)
    for width, (n, high, low) in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([width], pa.int32()), pa.array([n]), _lists(high[None]), _lists(low[None])],
            names=["width", "n", "high", "low"],
        )


def _means(fit: DataFrame) -> dict[int, Means]:
    """Exact means per width; the driver sees one number per width and dimension."""
    parts = fit.select("x").mapInArrow(_sum_task, _SUMS)
    both = F.arrays_zip("high", "low")
    wide = "decimal(38,0)"
    rows = (
        parts.select("width", "n", F.posexplode(both).alias("at", "s"))
        .groupBy("width", "at")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("s.high").cast("decimal(20,0)")).cast(wide).alias("high"),
            F.sum(F.col("s.low").cast("decimal(20,0)")).cast(wide).alias("low"),
        )
        .collect()
    )
    found: dict[int, Means] = {}
    for row in rows:
        means = found.setdefault(row["width"], Means(row["n"], [0] * row["width"]))
        means.sums[row["at"]] = (int(row["high"]) << _LIMB) + int(row["low"])
    return found


_FACTOR = "width int, node long, r array<double>"


def _factor_task(means: dict[int, Means]):
    """The triangular factor of a task's centred rows, block after block, per width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, x in _matrices(batch.column("x")):
                rows = means[width].centred(means[width].times_n(x))
                block = max(4 * width, 256)
                for start in range(0, len(rows), block):
                    above = factors.get(width, np.empty((0, width)))
                    stacked = np.vstack([above, rows[start : start + block]])
                    factors[width] = np.linalg.qr(stacked, mode="r")
        node = TaskContext.get().partitionId()
        for width, r in factors.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([width], pa.int32()), pa.array([node], pa.int64()), _lists(r.reshape(1, -1))],
                names=["width", "node", "r"],
            )

    return run


def _stacked(rows: pd.DataFrame) -> np.ndarray:
    width = int(rows["width"].iloc[0])
    ordered = rows.sort_values("node", kind="stable")
    return np.vstack([np.asarray(r, dtype=float).reshape(-1, width) for r in ordered["r"]])


def _reduce(rows: pd.DataFrame) -> pd.DataFrame:
    """Several triangular factors as one."""
    r = np.linalg.qr(_stacked(rows), mode="r")
    return pd.DataFrame(
        {"width": rows["width"].iloc[:1], "node": rows["_above"].iloc[:1], "r": [r.ravel()]}
    )


_AXES = "width int, component int, value double, total double, axis array<double>"


def _axes(count: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Squared singular values and right singular vectors of the last factor of a width."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(_stacked(rows), mode="r")
        width = r.shape[1]
        square = np.zeros((width, width))
        square[: len(r)] = r[:width]
        reduced = Bidiagonal(square)
        values = squared_singular_values(reduced.diagonal, reduced.above)
        axes = leading_vectors(reduced, values, min(count, width))
        # What rounding leaves of a singular value that is 0.
        noise = (4 * width * np.finfo(float).eps) ** 2 * values[0]
        kept = np.where(values > noise, values, 0.0)[: len(axes)]
        return pd.DataFrame(
            {
                "width": np.full(len(axes), width, np.int32),
                "component": np.arange(1, len(axes) + 1, dtype=np.int32),
                "value": kept,
                "total": np.full(len(axes), values.sum()),
                "axis": list(axes),
            }
        )

    return run


@dataclass
class Whitening:
    """Components of the vectors of one width, by falling variance."""

    means: Means
    axes: np.ndarray
    variance: np.ndarray
    explained: np.ndarray
    error: float | None = None

    def apply(self, exact: np.ndarray) -> np.ndarray:
        """Projections over the deviations; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            turned = self.means.centred(exact) @ self.axes.T
            return np.where(self.variance > 0, turned / np.sqrt(self.variance), np.nan)


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """Whitening of the vectors ``x``, per width (runs jobs).

    Each task reduces its centred rows, a block at a time, to one triangular factor;
    factors are stacked and reduced ``FAN`` at a time until one per width is left. Its
    bidiagonal form gives the singular values by dqds and the directions by twisted
    factorisations. What reaches the driver are exact sums, directions and variances: some
    ``components`` numbers per dimension of each width that occurs, however many rows.
    """
    means = _means(fit)
    if not means:
        return {}
    factors = materialise(fit.select("x").mapInArrow(_factor_task(means), _FACTOR), "factors")
    nodes = factors.agg(F.max("node")).first()[0] + 1
    while nodes > FAN:
        above = factors.withColumn("_above", F.floor(F.col("node") / FAN))
        factors = materialise(
            above.groupBy("width", "_above").applyInPandas(_reduce, _FACTOR), "factors"
        )
        nodes = -(-nodes // FAN)
    found: dict[int, list] = {}
    for row in factors.groupBy("width").applyInPandas(_axes(components), _AXES).collect():
        found.setdefault(row["width"], []).append(row)
    models = {}
    for width, rows in found.items():
        rows.sort(key=lambda row: row["component"])
        values = np.array([row["value"] for row in rows])
        total = rows[0]["total"]
        models[width] = Whitening(
            means[width],
            np.array([row["axis"] for row in rows]),
            values / means[width].n,
            values / total if total > 0 else np.zeros(len(values)),
        )
    for width, error in _identity_errors(fit, models).items():
        models[width].error = error
    return models


_MOMENTS = "width int, moments array<double>"


def _moment_task(models: dict[int, Whitening]):
    """Sums of the whitened rows and of their products, per width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, x in _matrices(batch.column("x")):
                model = models[width]
                y = model.apply(model.means.times_n(x))[:, model.variance > 0]
                moments = np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])
                found[width] = found.get(width, 0.0) + moments
        for width, moments in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([width], pa.int32()), _lists(moments[None])], names=["width", "moments"]
            )

    return run


def _identity_errors(fit: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """Largest entry of the whitened covariance minus the identity, per width.

    The rows are centred by exact sums before they are projected; the mean of the
    projections, rounding alone, is taken off as well.
    """
    rows = (
        fit.select("x")
        .mapInArrow(_moment_task(models), _MOMENTS)
        .select("width", F.posexplode("moments").alias("at", "value"))
        .groupBy("width", "at")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    sums: dict[int, dict[int, float]] = {}
    for row in rows:
        sums.setdefault(row["width"], {})[row["at"]] = row["value"]
    errors = {}
    for width, by_place in sums.items():
        n, count = models[width].means.n, int((models[width].variance > 0).sum())
        moments = np.array([by_place[at] for at in range(count + count * count)])
        mean = moments[:count] / n
        covariance = moments[count:].reshape(count, count) / n - np.outer(mean, mean)
        errors[width] = float(np.abs(covariance - np.eye(count)).max())
    return errors


_WHITENED = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double, width int"
)


def whiten(
    vectors: DataFrame,
    components: int = COMPONENTS,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Whitened leading components of every vector (runs jobs).

    An entry c becomes the integer x = floor(64 * c) + 1000000. Rows whose vector is null
    or empty, or holds null, non-finite or such large entries (2**56) that x has no 64-bit
    integer, are left out. Each distinct x-vector counts once in the fit, so a group of
    copies counts once however large it is. Vectors of different widths cannot share a
    covariance: each width has a fit of its own. The driver holds one model per width.

    Returns ``vec_id, component, n, deviation, whitened, explained, identity_error, width``
    for every row and component up to ``components`` or the width; ``n`` is the number of
    distinct vectors, ``deviation`` the exact sum of (n * x - S)**2, null beyond 64 bits.
    Components without variance, all of them when there is one distinct vector, have
    ``whitened`` null and ``explained`` 0, and stay out of ``identity_error``, which is
    null when no component is left. Rows equal in id, and null ids, are answered row by
    row. No rows in, no rows out.
    """
    usable = usable_vectors(vectors, id_column, vector_column)
    fit = materialise(usable.select("x").distinct(), "fit-list")
    models = fit_whitening(fit, components)
    shared = vectors.sparkSession.sparkContext.broadcast(models)  # components x width a width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for width, rows, x in _matrices(batch.column("x")):
                model = shared.value[width]
                exact = model.means.times_n(x)
                count = len(model.variance)
                again = pa.array(np.repeat(np.arange(len(rows)), count))
                each = len(rows) * count
                whitened = model.apply(exact).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows)).take(again),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(each, model.means.n)),
                        _deviations(exact).take(again),
                        pa.array(whitened, mask=np.isnan(whitened)),
                        pa.array(np.tile(model.explained, len(rows))),
                        pa.array([model.error] * each, pa.float64()),
                        pa.array(np.full(each, width, np.int32)),
                    ],
                    names=[
                        "vec_id", "component", "n", "deviation", "whitened", "explained",
                        "identity_error", "width",
                    ],
                )

    return usable.select("vec_id", "x").mapInArrow(run, _WHITENED)
