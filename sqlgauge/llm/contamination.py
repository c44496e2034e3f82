"""Benchmark passages in training texts: rare seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import MATCH_COLUMNS, match_columns, text_key, texts, with_match
from .words import _POWERS, BY_PUNCTUATION, column_bytes, mix, pieces, words

SEED_WORDS = 3
# An n-gram of an item is a seed if it occurs at most so many times as often as the rarer
# ones of that item, or so often at all.
OFTEN = 4
FEW = 32
# Words of benchmark items that one block holds, and so what a task is sent at once.
BLOCK_WORDS = 500_000
# Alignment: a word in common, another word instead, a word left out.
MATCH, SWAP, GAP = 1, -1, -1


def _folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts in lower case, letters beyond A-Z included."""
    return column_bytes(pc.utf8_lower(column.cast(pa.large_string())))


def grams(hashes: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram at every word, and whether it lies within one text."""
    n = max(0, len(hashes) - size + 1)
    factors = _POWERS(size + 8)[1 : size + 1]
    total = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        total += hashes[j : j + n] * factors[j]
    inside = np.ones(n, dtype=bool)
    for end in of[1:-1].tolist():
        inside[max(0, end - size + 1) : end] = False
    return mix(total), inside


class Lookup:
    """Membership in a sorted set of hashes, most misses by one look at a bit table."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self._table = np.zeros(1 << 20, dtype=bool)
        self._table[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which probes are members, and which member each is."""
        some = np.flatnonzero(self._table[(probes >> np.uint64(44)).astype(np.int64)])
        if not len(self.hashes) or not len(some):
            return some[:0], some[:0]
        at = np.minimum(np.searchsorted(self.hashes, probes[some]), len(self.hashes) - 1)
        good = self.hashes[at] == probes[some]
        return some[good], at[good]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: its score, and where it ends in item and text (exclusive).

    One row per item word; a run of gaps in the text is a running maximum along the row.
    """
    n = len(text)
    ramp = np.arange(n + 1) * -GAP
    above = np.zeros(n + 1, dtype=np.int64)
    best = (0, 0, 0)
    for i, word in enumerate(item):
        row = np.zeros(n + 1, dtype=np.int64)
        row[1:] = above[:-1] + np.where(text == word, MATCH, SWAP)
        row = np.maximum(np.maximum(row, above + GAP), 0)
        row = np.maximum.accumulate(row + ramp) - ramp
        end = int(row.argmax())
        if row[end] > best[0]:
            best = (int(row[end]), i + 1, end)
        above = row
    return best


@dataclass
class Block:
    """A bounded part of the benchmark, as the tasks use it."""

    item_ids: np.ndarray
    words: list[np.ndarray]
    seeds: Lookup
    starts: np.ndarray  # per seed, where its places begin
    items: np.ndarray  # per place, the item
    offsets: np.ndarray  # per place, the word of the item


def needed_score(length: int, similarity: float) -> int:
    """Score from which an alignment counts: a share of the item's words, but eight words
    (or all of a shorter item) at least."""
    return max(int(np.ceil(similarity * length - 1e-9)), min(length, 8))


def matches_of(
    hashes: np.ndarray, seeded: list[tuple[int, int]], block: Block, similarity: float
) -> list[dict]:
    """Items found in one text, from its seeds ``(text word, place)``."""
    by_item: dict[int, list[int]] = {}
    for word, place in seeded:
        by_item.setdefault(int(block.items[place]), []).append(word - int(block.offsets[place]))
    out = []
    for item, shifts in by_item.items():
        own = block.words[item]
        length = len(own)
        need = needed_score(length, similarity)
        slack = length // 2 + 2
        shifts = np.unique(shifts)
        cuts = np.flatnonzero(np.diff(shifts) > length) + 1
        best: dict | None = None
        places = 0
        for group in np.split(shifts, cuts):
            low = max(0, int(group[0]) - slack)
            window = hashes[low : int(group[-1]) + length + slack]
            if int(np.isin(own, window).sum()) * MATCH < need:
                continue
            score, item_end, end = align(own, window)
            if score < need:
                continue
            places += 1
            if best is None or score > best["score"]:
                _, _, back = align(own[:item_end][::-1], window[:end][::-1])
                best = {
                    "item_id": int(block.item_ids[item]),
                    "score": score,
                    "similarity": score / length,
                    "start": low + end - back,
                    "end": low + end,
                }
        if best is not None:
            out.append(best | {"places": places})
    return out


_FOUND = (
    "doc_id long, _key long, item_id long, score int, similarity double, "
    "start int, end int, places int"
)
_COLUMNS = {
    "item_id": pa.int64(),
    "score": pa.int32(),
    "similarity": pa.float64(),
    "start": pa.int32(),
    "end": pa.int32(),
    "places": pa.int32(),
}


def _benchmark_words(benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``block, item_id, words``: items as hashes, dealt into blocks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                _, hashes, of = words(*_folded(piece.column("text")), BY_PUNCTUATION)
                lists = pa.ListArray.from_arrays(
                    pa.array(of.astype(np.int32)), pa.array(hashes.view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [piece.column("item_id"), lists], names=["item_id", "words"]
                )

    items = benchmark.select(
        F.col(id_column).cast("long").alias("item_id"), F.col(text_column).alias("text")
    )
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    hashed = items.mapInArrow(run, "item_id long, words array<long>")
    return materialise(hashed.where(F.size("words") >= SEED_WORDS), "items")


def _count_task(lookup_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = lookup_of.value
        counts = np.zeros(len(lookup.hashes), dtype=np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                _, hashes, of = words(*_folded(piece.column("text")), BY_PUNCTUATION)
                found, inside = grams(hashes, of, SEED_WORDS)
                _, at = lookup.find(found[inside])
                counts += np.bincount(at, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lookup.hashes[some].view(np.int64)), pa.array(counts[some])],
            names=["gram", "n"],
        )

    return run


def _match_task(block_of, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = block_of.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                _, hashes, of = words(*_folded(piece.column("text")), BY_PUNCTUATION)
                found, inside = grams(hashes, of, SEED_WORDS)
                at, seed = block.seeds.find(found)
                keep = inside[at]
                at, seed = at[keep], seed[keep]
                row = np.searchsorted(of, at, "right") - 1
                rows: list[int] = []
                out: list[dict] = []
                for r in np.unique(row).tolist():
                    mine = np.flatnonzero(row == r) if len(row) < 64 else slice(
                        *np.searchsorted(row, [r, r + 1])
                    )
                    first = int(of[r])
                    seeded = [
                        (int(word) - first, place)
                        for word, s in zip(at[mine], seed[mine], strict=True)
                        for place in range(int(block.starts[s]), int(block.starts[s + 1]))
                    ]
                    hits = matches_of(hashes[first : int(of[r + 1])], seeded, block, similarity)
                    out.extend(hits)
                    rows.extend([r] * len(hits))
                index = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").take(index),
                        piece.column("_key").take(index),
                        *[pa.array([m[c] for m in out], t) for c, t in _COLUMNS.items()],
                    ],
                    names=["doc_id", "_key", *_COLUMNS],
                )

    return run


def rare_grams(item: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Which n-grams are seeds, from the item and the corpus count of each.

    N-grams that never occur cannot be seeds. The others count as rare next to the lower
    quartile of their item, so that an item copied into a third of all documents keeps its
    seeds, and so do the parts of an item that edits in some copies have not touched.
    """
    seeds = np.zeros(len(item), dtype=bool)
    cuts = np.flatnonzero(np.diff(item)) + 1
    for places in np.split(np.arange(len(item)), cuts):
        counts = often[places]
        if (counts > 0).any():
            limit = max(FEW, OFTEN * np.quantile(counts[counts > 0], 0.25))
            seeds[places] = (counts > 0) & (counts <= limit)
    return seeds


def _blocks(spark: SparkSession, items: DataFrame, docs: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks of about ``BLOCK_WORDS`` words, each with its seeds.

    An item's seeds are its n-grams that are rare in the training texts.
    """
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    n_blocks = -(-total // BLOCK_WORDS) if total else 0
    dealt = items.withColumn("_block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, n_blocks))))
    for number in range(n_blocks):
        part = dealt.where(F.col("_block") == number).orderBy("item_id", F.xxhash64("words"))
        rows = part.select("item_id", "words").collect()  # bounded: one block
        item_ids = np.array([r["item_id"] for r in rows], dtype=np.int64)
        own = [np.array(r["words"], dtype=np.int64).view(np.uint64) for r in rows]
        if not own:
            continue
        of = np.concatenate([[0], np.cumsum([len(w) for w in own])])
        found, inside = grams(np.concatenate(own), of, SEED_WORDS)
        at = np.flatnonzero(inside)
        item = np.searchsorted(of, at, "right") - 1
        gram, offset = found[at], at - of[item]
        lookup = spark.sparkContext.broadcast(Lookup(gram))
        counted = (
            docs.select("text")
            .mapInArrow(_count_task(lookup), "gram long, n long")
            .groupBy("gram")
            .agg(F.sum("n").alias("n"))
            .toArrow()  # at most one row per n-gram of the block
        )
        times = np.zeros(len(lookup.value.hashes), dtype=np.int64)
        seen = counted.column("gram").to_numpy().astype(np.int64).view(np.uint64)
        times[np.searchsorted(lookup.value.hashes, seen)] = counted.column("n").to_numpy()
        lookup.unpersist()
        often = times[np.searchsorted(lookup.value.hashes, gram)]
        chosen = np.flatnonzero(rare_grams(item, often))
        by_gram = chosen[np.argsort(gram[chosen], kind="stable")]
        seeds = Lookup(gram[by_gram])
        starts = np.searchsorted(gram[by_gram], seeds.hashes)
        yield Block(
            item_ids,
            own,
            seeds,
            np.append(starts, len(by_gram)),
            item[by_gram],
            offset[by_gram],
        )


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = 0.5,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """Which benchmark items each document holds, whole or edited.

    Words are runs of letters and digits in lower case. The n-grams of three words that
    are rare in the training texts, next to the others of an item, are its seeds. Where a
    document
    holds a seed, the stretch around it is aligned with the item by Smith-Waterman (a
    common word +1, another word or a gap -1). An item is found when the score reaches
    ``similarity`` of its words and eight words, or all of a shorter item. The benchmark
    is the query set: it is sent to the tasks in blocks of bounded size, and each block
    meets every document where it lies, so no text is shuffled.

    Returns ``doc_id, _key, item_id, score, similarity, start, end, places``: per document
    and item the best alignment, in words of the document, and how many stretches reach
    the score. Documents without a match do not appear. Null or empty texts hold nothing;
    items that are null or shorter than a seed are never found; an item given under one id
    with several texts is sought by each. Rows equal in id are answered each.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_column, text_column).withColumn("_key", text_key(F.col("text")))
    items = _benchmark_words(benchmark, item_column, item_text_column)
    found = None
    for block in _blocks(spark, items, rows):
        part = materialise(
            rows.mapInArrow(_match_task(spark.sparkContext.broadcast(block), similarity), _FOUND),
            "leaks",
        )
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], _FOUND)
    best = Window.partitionBy("doc_id", "_key", "item_id").orderBy(F.desc("score"), "start", "end")
    ranked = found.dropDuplicates().withColumn("_rank", F.row_number().over(best))
    return ranked.where("_rank = 1").drop("_rank")


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = 0.5,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay."""
    leaks = find_leaks(docs, benchmark, similarity, id_column, text_column)
    bad = leaks.select(*match_columns("doc_id", F.col("_key"))).distinct()
    rows = with_match(docs, id_column, text_column)
    return rows.join(bad, MATCH_COLUMNS, "left_anti").select("_row.*")
