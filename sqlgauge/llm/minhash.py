"""Near-duplicate documents by MinHash with tensored banding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import number_rows
from ..session import materialise
from .common import MATCH_COLUMNS, match_columns, task_count, text_key, texts, with_match
from .components import components
from .words import mix, pieces, shingle_sets

# Two collections of this many half keys, each made of this many minima: a link of
# similarity 0.8 is missed with probability 2 * (1 - 0.8**3)**16, about 2 in 100,000.
HALF_KEYS = 16
HALF_MINIMA = 3

_SKETCH = (
    "doc_id long, _key long, set_a long, set_b long, n_shingles long, halves array<long>, "
    "marks binary"
)
# Members of a bucket that all others are checked against first.
HUBS = 3
# Sets that one task compares with each other, and with as many others.
TILE = 512
# How many standard errors the similarity that the minima suggest may lie below the wanted
# one: four leave out a link of just that similarity 3 times in 100,000.
_ERRORS = 4.0


def _hashers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    factors = random.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, random.integers(0, 2**63, n, dtype=np.uint64)


def minima(sets: list[np.ndarray], factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function over each set; one row per set."""
    out = np.zeros((len(sets), len(factors)), dtype=np.uint64)
    for row, grams in enumerate(sets):
        if len(grams):
            least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
            for start in range(0, len(grams), 2048):
                part = grams[None, start : start + 2048] * factors[:, None]
                part += shifts[:, None]
                np.minimum(least, part.min(axis=1), out=least)
            out[row] = least
    return out


def _sketch(shingle: int, half_keys: int, half_minima: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = _hashers(seed, 2 * half_keys * half_minima)
        number = np.arange(2 * half_keys, dtype=np.uint64)
        for batch in batches:
            for first, sets in shingle_sets(batch.column("text"), shingle):
                piece = batch.slice(first, len(sets))
                least = minima(sets, factors, shifts)
                marks = (least & np.uint64(255)).astype(np.uint8)
                least = least.reshape(len(sets), -1, half_minima)
                halves = number[None, :].repeat(len(sets), axis=0)
                for k in range(half_minima):
                    halves = mix(halves + least[:, :, k])
                a = [int(s.sum(dtype=np.uint64)) for s in sets]
                b = [int(mix(s ^ np.uint64(seed)).sum(dtype=np.uint64)) for s in sets]
                flat = pa.array(halves.view(np.int64).ravel())
                ends = np.arange(len(sets) + 1, dtype=np.int32) * (2 * half_keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        piece.column("_key"),
                        pa.array(np.array(a, dtype=np.uint64).view(np.int64)),
                        pa.array(np.array(b, dtype=np.uint64).view(np.int64)),
                        pa.array(np.array([len(s) for s in sets], dtype=np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), flat),
                        pa.array([row.tobytes() for row in marks], pa.binary()),
                    ],
                    names=["doc_id", "_key", "set_a", "set_b", "n_shingles", "halves", "marks"],
                )

    return run


def sketches(
    keyed: DataFrame, shingle: int, half_keys: int, half_minima: int, seed: int
) -> DataFrame:
    """Per row: two fingerprints and the size of its shingle set, its half keys, and the
    last byte of each minimum."""
    return keyed.select("doc_id", "_key", "text").mapInArrow(
        _sketch(shingle, half_keys, half_minima, seed), _SKETCH
    )


def bucket_keys(sets: DataFrame, half_keys: int) -> DataFrame:
    """``key, rep, weight`` for every table key that can be shared.

    A table key joins half key i of the first collection with half key j of the second.
    Two sets can share it only if they share both halves, so halves that occur once are
    left out before any pair is formed, which loses nothing. ``weight`` is the number of
    keys of a set: those in the middle of a group share most.
    """
    halves = sets.select("rep", F.posexplode("halves").alias("i", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("_n")).where("_n > 1").select("half")
    kept = halves.join(shared, "half", "left_semi")
    sides = kept.groupBy("rep").agg(
        F.collect_list(F.when(F.col("i") < half_keys, F.col("half"))).alias("u"),
        F.collect_list(F.when(F.col("i") >= half_keys, F.col("half"))).alias("v"),
    )
    weight = (F.size("u") * F.size("v")).alias("weight")
    first = sides.select("rep", "v", weight, F.explode("u").alias("u"))
    return first.select("rep", "weight", "u", F.explode("v").alias("v")).select(
        F.xxhash64("u", "v").alias("key"), "rep", "weight"
    )


def _verify(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text_a"):
                sets = [
                    [s for _, part in shingle_sets(piece.column(side), shingle) for s in part]
                    for side in ("text_a", "text_b")
                ]
                good = np.zeros(piece.num_rows, dtype=bool)
                for row, (x, y) in enumerate(zip(*sets, strict=True)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[row] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("a"), piece.column("b"), pa.array(good)],
                    names=["a", "b", "linked"],
                )

    return run


def verify(pairs: DataFrame, reps: DataFrame, keyed: DataFrame, shingle: int, percent: int):
    """``a, b, linked`` for candidate pairs, decided on the full sets of both texts."""
    named = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))
    wanted = reps.join(named.distinct(), "rep", "left_semi").select(
        "rep", F.col("doc_id").alias("_id"), F.col("_key").alias("_k")
    )
    hit = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k"))
    found = materialise(
        keyed.join(wanted, hit).select("rep", "text").dropDuplicates(["rep"]), "texts"
    )
    a = found.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    b = found.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return materialise(
        joined.mapInArrow(
            _verify(shingle, percent), "a long, b long, linked boolean"
        ),
        "verified",
    )


def least_common(n: int, percent: int) -> int:
    """How many of ``n`` minima two linked sets have in common at least."""
    p = percent / 100
    return max(1, int(np.floor(n * p - _ERRORS * np.sqrt(n * p * (1 - p)))))


def _plausible(percent: int):
    """Keep the pairs whose sizes and minima allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(
                    batch.num_rows, -1
                )
                for c in ("marks_a", "marks_b")
            )
            n = np.stack([batch.column(c).to_numpy() for c in ("n_a", "n_b")])
            good = n.min(axis=0) * 100 >= n.max(axis=0) * percent
            good &= (x == y).sum(axis=1) >= least_common(x.shape[1], percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def hub_pairs(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: each member ``b`` of a bucket with the bucket's hubs.

    The sets are dealt into ``HUBS`` lots and the one of most keys in each lot is a hub, so
    the hubs of one group are the same in most of its buckets. They are found with
    map-side combining.
    """
    rank = F.struct("weight", "rep")
    lot = F.pmod(F.xxhash64("rep"), F.lit(HUBS))
    tops = [F.max(F.when(lot == k, rank)).alias(f"_h{k}") for k in range(HUBS)]
    hubs = F.array_compact(F.array(*[F.col(f"_h{k}.rep") for k in range(HUBS)]))
    chosen = (
        buckets.groupBy("key")
        .agg(F.count("*").alias("_n"), *tops)
        .where("_n > 1")
        .select("key", hubs.alias("hubs"))
    )
    met = buckets.join(chosen, "key").select("rep", "hubs").distinct()
    pairs = met.select(F.explode("hubs").alias("a"), F.col("rep").alias("b"))
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialise(pairs.distinct(), "met")

    def side(name: str) -> DataFrame:
        return sets.select(
            F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("marks").alias(f"marks_{name}")
        )

    sides = pairs.join(side("a"), "a").join(side("b"), "b")
    return sides.mapInArrow(_plausible(percent), "a long, b long")


def _set_rows(shingle: int):
    """The shingle set of every text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column("text"), shingle):
                grams = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep").slice(first, len(sets)), grams], names=["rep", "grams"]
                )

    return run


class _Forest:
    """Union-find over row numbers."""

    def __init__(self, labels: np.ndarray):
        first: dict[int, int] = {}
        self.parent = [first.setdefault(label, i) for i, label in enumerate(labels.tolist())]

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i


def _tile_links(rows: list[dict], percent: int, half_keys: int) -> list[tuple[int, int]]:
    """Links that join components within one group of sets, each confirmed on full sets.

    Candidates share a table key (half keys of either collection), and enough of all
    minima; the likeliest come first, and pairs that hang together already are passed by.
    """
    tile = np.array([row["tile"] for row in rows])
    labels = np.array([row["component"] for row in rows])
    if (labels == labels[0]).all():
        return []
    marks = np.frombuffer(b"".join(row["marks"] for row in rows), np.uint8)
    marks = marks.reshape(len(rows), -1)
    size = np.array([row["n"] for row in rows])
    grams = [np.frombuffer(row["grams"], np.uint64) for row in rows]
    forest = _Forest(labels)
    minima_ = marks.shape[1] // (2 * half_keys)
    least = least_common(marks.shape[1], percent)
    alone = tile[0] == tile[-1]
    order: list[tuple[int, int, int]] = []
    for i in range(len(rows)):
        others = np.arange(i + 1, len(rows))
        if not alone:
            others = others[tile[others] != tile[i]]
        low, high = np.minimum(size[i], size[others]), np.maximum(size[i], size[others])
        others = others[(labels[others] != labels[i]) & (low * 100 >= high * percent)]
        if not len(others):
            continue
        equal = marks[others] == marks[i]
        common = equal.sum(axis=1)
        halves = equal.reshape(len(others), 2, half_keys, minima_).all(axis=3).any(axis=2).all(axis=1)
        for j in np.flatnonzero(halves & (common >= least)).tolist():
            order.append((-int(common[j]), i, int(others[j])))
    out = []
    for _, i, j in sorted(order):
        a, b = forest.root(i), forest.root(j)
        if a == b:
            continue
        both = len(np.intersect1d(grams[i], grams[j], assume_unique=True))
        if both and 100 * both >= percent * (size[i] + size[j] - both):
            forest.parent[b] = a
            out.append((rows[i]["rep"], rows[j]["rep"]))
    return out


def _tile_task(percent: int, half_keys: int):
    """Compare the groups of ``cluster, first, second``, whose rows arrive together."""

    def settle(rows: list[dict]) -> pa.RecordBatch:
        links = _tile_links(rows, percent, half_keys)
        return pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        name = None
        for batch in batches:
            for row in batch.to_pylist():
                this = (row["cluster"], row["first"], row["second"])
                if this != name and rows:
                    yield settle(rows)
                    rows = []
                name = this
                rows.append(row)
        if rows:
            yield settle(rows)

    return run


def rest_links(
    buckets: DataFrame,
    sets: DataFrame,
    groups: DataFrame,
    keyed: DataFrame,
    shingle: int,
    percent: int,
    half_keys: int,
) -> DataFrame:
    """``a, b``: links between sets of one bucket that its hubs have left apart.

    Buckets with members in several components are joined to clusters where they share
    members. A cluster is cut into tiles of ``TILE`` sets and every two tiles meet in one
    task, which compares their minima as matrices and returns only links that join
    components. No pairs are written, and no task holds more than two tiles.
    """
    placed = buckets.join(groups, buckets["rep"] == groups["node"], "left").select(
        "key", "rep", "weight", F.coalesce("component", "rep").alias("component")
    )
    mixed = (
        placed.groupBy("key")
        .agg(
            F.min("component").alias("_low"),
            F.max("component").alias("_high"),
            # The member of most keys is the same in most buckets of a group.
            F.max(F.struct("weight", "rep")).alias("_top"),
            F.count("*").alias("_n"),
        )
        .where("_low < _high AND _n > 2")
        .select("key", F.col("_top.rep").alias("hub"))
    )
    open_ = placed.join(mixed, "key").select("rep", "component", "hub").distinct()
    open_ = materialise(open_, "open")
    clusters = components(open_, "hub", "rep").withColumnsRenamed(
        {"node": "rep", "component": "cluster"}
    )
    members = open_.select("rep", "component").distinct().join(clusters, "rep")
    members = number_rows(members, ["rep"], ["cluster"], "_place")
    members = materialise(
        members.withColumn("tile", F.floor(F.col("_place") / TILE).cast("int")), "members"
    )
    tiles = members.groupBy("cluster").agg(F.max("tile").alias("_last"))
    wanted = sets.join(members.select("rep"), "rep", "left_semi").select(
        "rep", F.col("doc_id").alias("_id"), F.col("_key").alias("_k")
    )
    hit = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k"))
    texts_ = keyed.join(wanted, hit).select("rep", "text").dropDuplicates(["rep"])
    found = materialise(texts_.mapInArrow(_set_rows(shingle), "rep long, grams binary"), "grams")
    full = (
        members.join(tiles, "cluster")
        .join(sets.select("rep", "n", "marks"), "rep")
        .join(found, "rep")
        .withColumn("_other", F.explode(F.sequence(F.lit(0), "_last")))
        .withColumns(
            {"first": F.least("tile", "_other"), "second": F.greatest("tile", "_other")}
        )
    )
    columns = ["cluster", "first", "second", "tile", "rep", "component", "n", "marks", "grams"]
    n = task_count(keyed.sparkSession, 0, 1)
    dealt = full.select(*columns).repartition(n, "cluster", "first", "second")
    return dealt.sortWithinPartitions("cluster", "first", "second", "tile", "rep").mapInArrow(
        _tile_task(percent, half_keys), "a long, b long"
    )


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    half_keys: int = HALF_KEYS,
    half_minima: int = HALF_MINIMA,
    seed: int = 11,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Documents with the component of near copies each belongs to.

    Words are runs of characters that are not ASCII white space, A-Z lower-cased; a
    document's set holds its distinct shingles of ``shingle`` words (all words as one,
    when there are fewer). Two documents are linked when 100 times the common shingles is
    at least ``percent`` times the united ones.

    Equal sets are merged first, so a thousand copies count as one from then on. Two
    collections of ``half_keys`` half keys are combined to half_keys squared table keys
    per set at the price of 2 * half_keys. In each bucket every set is checked against a
    few hubs. Buckets whose members this leaves apart are compared in tiles of bounded
    size, by tasks that return only links between components; a bucket whose members hang
    together costs no pairs. Every link is confirmed on full sets.

    Returns ``doc_id, _key, n_shingles, component_id, kept``, one row per row given (``_key``
    is a hash of the text, ``_component`` a number of the component, null without one).
    ``component_id`` is the smallest doc_id of the component. Null or empty texts, and
    texts of white space, have no shingles and stay alone, as do rows of null id without a
    near copy, whose component_id is null; null ids are never a component's name if it has
    another. Rows equal in id and text are each returned. No rows in, no rows out.
    """
    keyed = texts(docs, id_column, text_column).withColumn("_key", text_key(F.col("text")))
    rows = materialise(sketches(keyed, shingle, half_keys, half_minima, seed), "sketches")
    place = F.struct("doc_id", "_key")
    sets = (
        rows.where("n_shingles > 0")
        .groupBy("set_a", "set_b")
        .agg(
            F.min(place).alias("_first"),
            F.min("doc_id").alias("least_id"),
            F.first("n_shingles").alias("n"),
            F.first("halves").alias("halves"),
            F.first("marks").alias("marks"),
        )
        .select(
            F.monotonically_increasing_id().alias("rep"),
            "set_a",
            "set_b",
            "least_id",
            "n",
            "halves",
            "marks",
            "_first.doc_id",
            "_first._key",
        )
    )
    sets = materialise(sets, "sets")
    buckets = materialise(bucket_keys(sets.select("rep", "halves"), half_keys), "buckets")
    pairs = materialise(hub_pairs(buckets, sets, percent), "pairs")
    checked = verify(pairs, sets, keyed, shingle, percent)
    groups = materialise(components(checked.where("linked")), "groups")
    fresh = materialise(
        rest_links(buckets, sets, groups, keyed, shingle, percent, half_keys), "links"
    )
    if not fresh.isEmpty():
        spanning = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        groups = materialise(components(spanning.unionByName(fresh)), "groups")

    named = sets.join(groups, sets["rep"] == groups["node"], "left").select(
        "set_a", "set_b", "least_id", F.coalesce("component", "rep").alias("component")
    )
    names = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_set = named.join(names, "component").select(
        "set_a", "set_b", "component_id", F.col("component").alias("_component")
    )
    component_id = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (
        rows.select("doc_id", "_key", "n_shingles", "set_a", "set_b")
        .join(of_set, ["set_a", "set_b"], "left")
        .select(
            "doc_id",
            "_key",
            "n_shingles",
            component_id.alias("component_id"),
            F.col("doc_id").eqNullSafe(component_id).alias("kept"),
            "_component",
        )
    )


def drop_near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` with one row of each component left: the one of the smallest id.

    All columns stay. Of rows equal in id and text one stays, too. Rows without shingles
    all stay but for such repetitions.
    """
    found = near_duplicates(
        docs, shingle, percent, id_column=id_column, text_column=text_column
    )
    place = found.select("_component", *match_columns("doc_id", F.col("_key")))
    firsts = (
        place.where("_component IS NOT NULL")
        .groupBy("_component")
        .agg(F.min(F.struct(*MATCH_COLUMNS)).alias("_first"))
        .select("_first.*")
    )
    alone = place.where("_component IS NULL").select(*MATCH_COLUMNS).distinct()
    kept = materialise(firsts.unionByName(alone), "kept")
    rows = with_match(docs, id_column, text_column).join(kept, MATCH_COLUMNS, "left_semi")
    once = Window.partitionBy(*MATCH_COLUMNS).orderBy("_key")
    return (
        rows.withColumn("_copy", F.row_number().over(once)).where("_copy = 1").select("_row.*")
    )
