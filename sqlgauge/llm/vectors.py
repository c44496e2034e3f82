"""Near-duplicate vectors by tiled comparison along principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import number_rows
from ..session import materialise
from .components import components

# Vectors of one tile and of one block; a task compares two blocks at a time.
TILE = 512
BLOCK = 8192
# Leading dimensions after which pairs are tested, as shares of all.
STAGES = (0.25, 0.5)
# The first test of a tile runs in single precision and lets this much more through.
_COARSE = 1e-4
_SLACK = 1e-9


def unit_rows(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and which of them can be."""
    finite = np.isfinite(raw).all(axis=1)
    largest = np.abs(np.where(finite[:, None], raw, 0.0)).max(axis=1, initial=0.0)
    good = finite & (largest > 0)
    scaled = raw[good] / largest[good, None]
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None], good


def by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Width, row numbers and matrix of doubles for each width among the vectors given."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for width in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == width)
        values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield width, rows, values.astype(np.float64).reshape(len(rows), width)


def _as_lists(matrix: np.ndarray) -> pa.Array:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()))


_UNIT = "vec_id long, width int, unit array<double>"


def _unit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for width, rows, raw in by_width(batch.column("vector")):
            unit, good = unit_rows(raw)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(rows[good])),
                    pa.array(np.full(len(unit), width, dtype=np.int32)),
                    _as_lists(unit),
                ],
                names=["vec_id", "width", "unit"],
            )


def principal_axes(classes: DataFrame, block: int) -> dict[int, np.ndarray]:
    """Axes of the unit vectors' second moments, largest first, for each width of more
    than one block; others need none to be compared.

    Each task adds up one width x width matrix per width; those are added up entry by
    entry, so the driver sees one matrix per width.
    """
    sizes = classes.groupBy("width").count().where(F.col("count") > block)
    large = {row["width"] for row in sizes.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, unit in by_width(batch.column("unit")):
                if width in large:
                    total[width] = total.get(width, 0.0) + unit.T @ unit
        for width, moments in total.items():
            size = width * width
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(size, width, dtype=np.int32)),
                    pa.array(np.arange(size)),
                    pa.array(moments.ravel()),
                ],
                names=["width", "at", "value"],
            )

    if not large:
        return {}
    summed = (
        classes.select("unit")
        .mapInArrow(run, "width int, at long, value double")
        .groupBy("width", "at")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    found = {width: np.zeros(width * width) for width in large}
    for row in summed:
        found[row["width"]][row["at"]] = row["value"]
    axes = {}
    for width, moments in found.items():
        square = moments.reshape(width, width)
        axes[width] = np.linalg.eigh((square + square.T) / 2)[1][:, ::-1]
    return axes


_PLACED = "cls long, weight long, width int, axis double, unit array<double>"


def _place(axes: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, rows, unit in by_width(batch.column("unit")):
                turned = np.ascontiguousarray(unit @ axes[width] if width in axes else unit)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("cls").take(at),
                        batch.column("weight").take(at),
                        pa.array(np.full(len(rows), width, dtype=np.int32)),
                        pa.array(turned[:, 0]),
                        _as_lists(turned),
                    ],
                    names=["cls", "weight", "width", "axis", "unit"],
                )

    return run


class Turned:
    """Turned unit vectors with the norms of what follows each cut."""

    def __init__(self, unit: np.ndarray):
        width = unit.shape[1]
        self.unit = unit
        self.cuts = sorted({max(1, int(width * share)) for share in STAGES} | {width})
        tails = np.sqrt(np.maximum(0, np.cumsum((unit * unit)[:, ::-1], axis=1)[:, ::-1]))
        self.tails = {cut: tails[:, cut] for cut in self.cuts[:-1]}
        self.tails[width] = np.zeros(len(unit))
        first = self.cuts[0]
        # Leading part and tail norm side by side: one product gives the first bound.
        self.lead = np.column_stack([unit[:, :first], self.tails[first]]).astype(np.float32)


def close_pairs(
    all_: Turned, x: slice, y: slice, cosine: float
) -> tuple[np.ndarray, np.ndarray]:
    """Rows of tile ``x`` and rows of tile ``y`` whose product is at least ``cosine``.

    Products are summed over the leading dimensions first. What the others can add is at
    most the product of the norms of the two suffixes; pairs that cannot reach the
    threshold with that are dropped before the next dimensions are added. A tile against
    itself gives each pair once.
    """
    bound = all_.lead[x] @ all_.lead[y].T
    hit = np.flatnonzero(bound >= np.float32(cosine - _COARSE))
    i, j = hit // bound.shape[1] + x.start, hit % bound.shape[1] + y.start
    if x == y:
        i, j = i[i < j], j[i < j]
    total = np.zeros(len(i))
    low = 0
    for high in all_.cuts[1:] if len(all_.cuts) > 1 else all_.cuts:
        for at in range(0, len(i), 1 << 17):
            part = slice(at, at + (1 << 17))
            total[part] += np.einsum(
                "nd,nd->n", all_.unit[i[part], low:high], all_.unit[j[part], low:high]
            )
        slack = 1e-15 if high == all_.cuts[-1] else _SLACK
        keep = total + all_.tails[high][i] * all_.tails[high][j] >= cosine - slack
        i, j, total, low = i[keep], j[keep], total[keep], high
    return i, j


def _link(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest members of all components after some more links."""
    while len(i):
        a, b = root[i], root[j]
        changed = a != b
        if not changed.any():
            break
        i, j, a, b = i[changed], j[changed], a[changed], b[changed]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root


_FOUND = "cls long, n long, root long"


def _compare(cosine: float):
    """Links between the vectors of two blocks, counted and joined tile by tile."""

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "axis", "cls"], kind="stable")
        block = rows["block"].to_numpy()
        cls, weight = rows["cls"].to_numpy(), rows["weight"].to_numpy()
        unit = np.stack(rows["unit"].to_numpy())
        split = int(np.searchsorted(block, block[0], "right"))
        same = split == len(rows)
        lefts = [(a, min(a + TILE, split)) for a in range(0, split, TILE)]
        rights = [(a, min(a + TILE, len(rows))) for a in range(split, len(rows), TILE)]
        rights = lefts if same else rights
        axis = unit[:, 0]
        reach = np.sqrt(2 - 2 * cosine) + 1e-9
        n, root = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        turned = Turned(unit)
        for a, b in lefts:
            for c, d in rights:
                if same and c < a:
                    continue
                # Tiles are stretches along the first axis; too far apart, no pair is close.
                if axis[c] - axis[b - 1] > reach or axis[a] - axis[d - 1] > reach:
                    continue
                i, j = close_pairs(turned, slice(a, b), slice(c, d), cosine)
                np.add.at(n, i, weight[j])
                np.add.at(n, j, weight[i])
                root = _link(root, i, j)
        some = np.flatnonzero(n)
        return pd.DataFrame({"cls": cls[some], "n": n[some], "root": cls[root[some]]})

    return run


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.9,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """Vectors with the number of close ones and the component each belongs to.

    Vectors are scaled to length one; equal ones count as one with a weight from there on,
    so copies cost nothing. They are turned onto the principal axes of their width, sorted
    along the first axis and cut into blocks of about ``block``. Every two blocks of a
    width that are near enough on that axis are compared by one task, tile by tile, the
    leading dimensions first. A task returns, per vector, how many links it found and the
    smallest row they tie it to: never the pairs, and it holds those of one tile at a time.

    Every pair of blocks within reach is compared, so the work grows with the square of
    the number of different vectors when the first axis does not separate them.

    Returns ``vec_id, n_links, component_id, kept``, one row per row given. Links have a
    cosine of at least ``cosine`` in double precision; vectors of different widths have
    none. Vectors that are null, empty, zero, or that hold null or non-finite components
    link with nothing, nor do rows of null id. Rows equal in id are answered as one vector
    with the links of all of them. No rows in, no rows out.
    """
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector")
    )
    complete = (
        "vector IS NOT NULL AND size(vector) > 0 AND vec_id IS NOT NULL "
        "AND NOT exists(vector, x -> x IS NULL)"
    )
    same = ["width", "_a", "_b"]
    units = materialise(
        rows.where(complete)
        .mapInArrow(_unit_task, _UNIT)
        .select("*", F.xxhash64("unit").alias("_a"), F.xxhash64(F.lit(1), "unit").alias("_b")),
        "units",
    )
    classes = materialise(
        units.groupBy(*same)
        .agg(F.first("unit").alias("unit"), F.count("*").alias("weight"))
        .withColumn("cls", F.monotonically_increasing_id()),
        "classes",
    )
    axes = principal_axes(classes, block)
    placed = materialise(
        classes.select("cls", "weight", "unit").mapInArrow(_place(axes), _PLACED), "turned"
    )
    numbered = number_rows(placed, ["axis", "cls"], ["width"], "_row")
    blocked = materialise(
        numbered.withColumn("block", F.floor(F.col("_row") / block)).drop("_row"), "blocks"
    )
    found = materialise(_compared(blocked, cosine), "close")
    counts = found.groupBy("cls").agg(F.sum("n").alias("_n"))
    members = units.select("vec_id", *same).join(
        classes.select("cls", "weight", *same).join(counts, "cls", "left"), same
    )
    members = materialise(
        members.select(
            "vec_id", "cls", (F.coalesce("_n", F.lit(0)) + F.col("weight") - 1).alias("n")
        ),
        "members",
    )
    # An id with several vectors ties their classes together.
    per_id = members.groupBy("vec_id").agg(F.min("cls").alias("_least"), F.sum("n").alias("n_links"))
    ties = members.join(per_id, "vec_id").where("cls <> _least").select(
        F.col("cls"), F.col("_least").alias("root")
    )
    groups = components(found.select("cls", "root").unionByName(ties), "cls", "root")
    named = per_id.join(groups, F.col("_least") == F.col("node"), "left").select(
        "vec_id", "n_links", F.coalesce("component", "_least").alias("_group")
    )
    least = named.groupBy("_group").agg(F.min("vec_id").alias("component_id"))
    return _answered(rows, named.join(least, "_group").select("vec_id", "n_links", "component_id"))


def _near_blocks(blocked: DataFrame, cosine: float) -> DataFrame:
    """``width, first, second`` for every two blocks with vectors near enough on the first
    axis.

    Blocks are stretches along the axis, so a block's partners are those up to the last
    that begins within reach of its end: one row per block, sorted once.
    """
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    spans = blocked.groupBy("width", "block").agg(
        F.min("axis").alias("low"), F.max("axis").alias("high")
    )
    begins = spans.select("width", F.col("low").alias("at"), F.lit(0).alias("kind"), "block")
    ends = spans.select(
        "width", (F.col("high") + reach).alias("at"), F.lit(1).alias("kind"), "block"
    )
    along = (
        Window.partitionBy("width")
        .orderBy("at", "kind", "block")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    begun = F.max(F.when(F.col("kind") == 0, F.col("block"))).over(along)
    last = begins.unionByName(ends).withColumn("_last", begun).where("kind = 1")
    return last.select(
        "width",
        F.col("block").alias("first"),
        F.explode(F.sequence("block", "_last")).alias("second"),
    )


def _compared(blocked: DataFrame, cosine: float) -> DataFrame:
    near = materialise(_near_blocks(blocked, cosine), "near")
    pair = ["width", "first", "second"]
    sides = near.select(*pair, F.col("first").alias("block")).unionByName(
        near.where("first < second").select(*pair, F.col("second").alias("block"))
    )
    sent = blocked.join(sides, ["width", "block"])
    return sent.groupBy(*pair).applyInPandas(_compare(cosine), _FOUND)


def _answered(rows: DataFrame, linked: DataFrame) -> DataFrame:
    out = rows.select("vec_id").join(
        linked.withColumnRenamed("component_id", "_component"), "vec_id", "left"
    )
    component = F.coalesce("_component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
