"""Repeated byte strings, found by longest-previous-factor arrays.

A suffix array of the whole corpus cannot be built in one place. Suffixes that share
``DEAL_BYTES`` bytes also share the smallest hash among the short grams at the start of
those bytes, so suffixes are dealt to tasks by that smallest hash. Neighbouring suffixes
mostly have it in common and travel as one stretch of text, and stretches whose hash does
not occur again never travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import task_count, text_key, texts
from .words import BY_SPACE, column_bytes, mix, overlapping

MIN_BYTES = 400
# Repeated passages of so many words are told as well, if they have DEAL_BYTES at least.
PASSAGE_WORDS = 50
DEAL_BYTES = 192
# Suffixes of one stretch at most; the text of a stretch is MIN_BYTES - 1 bytes longer.
STRETCH = 512
# Stretches under one hash that one task sorts; more are compared by hashes of windows.
MOST_STRETCHES = 4096
# Bytes sorted together, as long as one group does not need more.
_TASK_BYTES = 300_000
# Behind every stretch in a task: a byte that text in UTF-8 never holds.
_END = b"\xff"

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix(np.arange(100, 132, dtype=np.uint64)) | np.uint64(1)


def _grams(raw: np.ndarray, doublings: int) -> np.ndarray:
    """Hashes of all strings of ``2 ** doublings`` bytes."""
    h = _BYTE[raw]
    for step in range(doublings):
        n = 1 << step
        h = h[:-n] * _FACTORS[step] + h[n:]
    return mix(h)


def _layout(deal_bytes: int) -> tuple[int, int]:
    """Doublings for the gram and for the number of grams whose smallest counts."""
    gram = max(0, (deal_bytes // 3).bit_length() - 1)
    window = (deal_bytes - (1 << gram) + 1).bit_length() - 1
    return gram, window


class Rule:
    """What counts as a repeat: strings of ``min_bytes``, and passages of ``words`` words
    that take ``deal_bytes`` at least; of what takes more than ``min_bytes`` so many count."""

    def __init__(self, min_bytes: int, words: int = PASSAGE_WORDS, deal_bytes: int = DEAL_BYTES):
        self.min_bytes, self.words = min_bytes, words
        self.deal_bytes = min(min_bytes, deal_bytes)

    def passages(
        self, raw: np.ndarray, bounds: np.ndarray, ended: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the passages from every separator on.

        A passage starts with the separator before its first word, so that it begins with
        a whole word, and ends with a whole word. ``ended`` says which texts end where
        their bytes do; of others the last word may go on.
        """
        solid = BY_SPACE[raw] != 0
        edges = np.concatenate([bounds[:-1][bounds[:-1] < bounds[1:]], [len(raw)]])
        starts, stops = solid.copy(), solid.copy()
        starts[1:] &= ~solid[:-1]
        starts[edges[:-1]] = solid[edges[:-1]]
        stops[:-1] &= ~solid[1:]
        stops[edges[1:] - 1] = solid[edges[1:] - 1]
        first, end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        end = np.append(end[self.words - 1 :], np.full(self.words, 1 << 62))[: len(first)]
        row = np.searchsorted(bounds, first, "right") - 1
        limit = bounds[row + 1]
        begin, reach = first - 1, first - 1 + self.min_bytes
        # Within the first min_bytes bytes the last word is seen to its end.
        told = (end < reach) & ((end < limit) | (end == limit) & ended[row])
        good = (first > bounds[row]) & (told | (end >= reach) & (reach <= limit))
        end = np.where(told, end, reach)
        good &= end - begin >= self.deal_bytes
        return begin[good], end[good]


def stretches(
    raw: np.ndarray, bounds: np.ndarray, rule: Rule, owned: np.ndarray, ended: np.ndarray
) -> dict[str, np.ndarray]:
    """The stretches of all texts: neighbouring suffixes with one smallest hash.

    Of each text the first ``owned`` suffixes are taken. ``least`` is the hash,
    ``content`` a hash of all bytes of the stretch, ``row`` the text, ``at`` the first
    suffix, ``n`` their number, ``whole`` how many of them have ``min_bytes`` bytes,
    ``p_from`` and ``p_to`` the bytes that its passages cover, -1 without any, and
    ``inner`` whether the smallest hash occurs twice inside, without which a stretch
    cannot repeat itself.
    """
    gram, window = _layout(rule.deal_bytes)
    sizes = np.diff(bounds)
    taken = np.clip(np.minimum(owned, sizes - rule.deal_bytes + 1), 0, None)
    some = np.flatnonzero(taken > 0)
    if not len(some):
        return {name: np.empty(0, np.int64) for name, _ in _STRETCH_FIELDS}
    h = _grams(raw, gram)
    least = h
    for step in range(window):
        least = np.minimum(least[: -(1 << step)], least[1 << step :])
    change = np.zeros(len(raw) + 1, dtype=np.int32)
    change[bounds[some]] += 1
    np.subtract.at(change, bounds[some] + taken[some], 1)
    valid = np.cumsum(change, dtype=np.int32)[: len(least)] > 0
    begins = valid.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    begins[bounds[some]] = True
    starts = np.flatnonzero(begins)
    row = np.searchsorted(bounds, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(raw)), bounds[row] + taken[row])
    # Long stretches, which only periodic text has, are cut from their start.
    pieces_ = -(-(ends - starts) // STRETCH)
    first = np.cumsum(pieces_) - pieces_
    step = np.arange(int(pieces_.sum())) - np.repeat(first, pieces_)
    row = np.repeat(row, pieces_)
    limit = np.repeat(ends, pieces_)
    starts = np.repeat(starts, pieces_) + step * STRETCH
    n = np.minimum(limit - starts, STRETCH)
    length = np.minimum(n + rule.min_bytes - 1, bounds[row + 1] - starts)

    value = least[starts]
    content = mix(value + n.astype(np.uint64) + (length.astype(np.uint64) << np.uint64(20)))
    last = starts + length - (1 << gram)
    for j in range(-(-(STRETCH + rule.min_bytes) >> gram) + 1):
        content = mix(content * np.uint64(31) + h[np.minimum(starts + (j << gram), last)])
    spans = n + (1 << window) - 1
    offsets = np.cumsum(spans) - spans
    index = np.repeat(starts - offsets, spans) + np.arange(int(spans.sum()))
    equal = h[index] == np.repeat(value, spans)
    inner = np.add.reduceat(equal.astype(np.int32), offsets) > 1
    begin, end = rule.passages(raw, bounds, ended)
    low, high = np.searchsorted(begin, starts), np.searchsorted(begin, starts + n)
    held = high > low
    p_from, p_to = np.full(len(starts), -1), np.full(len(starts), -1)
    p_from[held] = begin[low[held]] + 1 - starts[held]
    p_to[held] = np.maximum.accumulate(end)[high[held] - 1] - starts[held]
    return {
        "least": value.view(np.int64),
        "content": content.view(np.int64),
        "row": row,
        "at": starts - bounds[row],
        "n": n,
        "whole": np.clip(length - rule.min_bytes + 1, 0, n),
        "p_from": p_from,
        "p_to": p_to,
        "inner": inner,
    }


_STRETCH_FIELDS = [
    ("least", pa.int64()), ("content", pa.int64()), ("row", pa.int64()), ("at", pa.int64()),
    ("n", pa.int32()), ("whole", pa.int32()), ("p_from", pa.int32()), ("p_to", pa.int32()),
    ("inner", pa.bool_()),
]


def _stretch_rows(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = overlapping(batch.column("text"), 1_000_000, STRETCH + 2 * rule.min_bytes)
            for raw, bounds, rows, offset, owned, ended in parts:
                found = stretches(raw, bounds, rule, owned, ended)
                row = pa.array(rows[found["row"]] if len(found["row"]) else found["row"])
                found["at"] = found["at"] + offset
                columns = {
                    name: pa.array(found[name].astype(kind.to_pandas_dtype()))
                    for name, kind in _STRETCH_FIELDS
                    if name != "row"
                }
                columns["doc_id"] = batch.column("doc_id").take(row)
                columns["_key"] = batch.column("_key").take(row)
                names = [c.split()[0] for c in _STRETCH.split(", ")]
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return run


_STRETCH = (
    "least long, content long, doc_id long, _key long, at long, n int, whole int, p_from int, "
    "p_to int, inner boolean"
)


# --- suffix order -----------------------------------------------------------------


class Suffixes:
    """Suffix order of some positions of a text, and common prefixes, up to ``cap`` bytes.

    Ranks of prefixes of 8 bytes give those of three times the length, and so on; two
    overlapping ones give the ranks of ``cap`` bytes.
    """

    def __init__(self, raw: np.ndarray, positions: np.ndarray, cap: int):
        self.raw = np.append(raw, np.zeros(cap + 16, dtype=np.uint8))
        self.cap, self.positions = cap, positions
        n = len(raw)
        key = np.zeros(n + cap, dtype=np.uint64)
        for j in range(8):
            key = (key << np.uint64(8)) | self.raw[j : j + n + cap]
        rank, size = self._ranked(key), 8
        self.levels = [(size, rank)]
        while size * 2 < cap:
            # Three ranks fit into 64 bits while there are fewer than 2**21 of them.
            times = 3 if size * 3 <= cap and n + cap < 1 << 21 else 2
            bits = np.uint64(21 if times == 3 else 32)
            key = rank.astype(np.uint64)
            for j in range(1, times):
                ahead = np.append(rank[j * size :], np.zeros(j * size, dtype=rank.dtype))
                key = (key << bits) | ahead
            rank, size = self._ranked(key), size * times
            self.levels.append((size, rank))
        whole = (rank[positions].astype(np.uint64) << np.uint64(32)) | rank[positions + cap - size]
        self.order = np.argsort(whole)

    @staticmethod
    def _ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.ones(len(key), dtype=np.uint32)
        fresh[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(len(key), dtype=np.uint32)
        rank[order] = np.cumsum(fresh, dtype=np.uint32)
        return rank

    def common(self) -> np.ndarray:
        """Common prefix of each suffix in order with the one before it; the first has 0."""
        at = self.positions[self.order]
        a, b = at[1:], at[:-1]
        length = np.zeros(len(a), dtype=np.int64)
        above = self.cap
        for size, rank in reversed(self.levels):
            for _ in range(-(-above // size)):
                same = (length + size <= self.cap) & (rank[a + length] == rank[b + length])
                length += np.where(same, size, 0)
            above = size
        for _ in range(8):
            same = (length < self.cap) & (self.raw[a + length] == self.raw[b + length])
            length += same
        return np.concatenate([[0], length]) if len(at) else length


def previous_factors(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Length of the longest match of each suffix with one of smaller number.

    ``order`` lists suffix numbers in suffix order. The nearest smaller numbers before
    and after a suffix in that order are its best earlier matches; one walk with a stack
    finds both. Suffixes without a neighbour that shares ``least`` bytes get 0.
    """
    factor = [0] * len(order)
    close = common >= least
    linked = close.copy()
    linked[:-1] |= close[1:]
    stack: list[tuple[int, int]] = []  # suffix number, match with the next smaller before it
    for place in np.flatnonzero(linked).tolist():
        number = int(order[place])
        shared = int(common[place]) if close[place] else 0
        if not shared:
            stack.clear()
        while stack and stack[-1][0] > number:
            top, match = stack.pop()
            # ``number`` follows ``top`` as its nearest smaller one.
            factor[top] = max(factor[top], shared)
            shared = min(shared, match)
        factor[number] = max(factor[number], shared if stack else 0)
        stack.append((number, shared))
    return np.array(factor, dtype=np.int64)


def next_factors(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """The mirror: the longest match of each suffix with one of larger number."""
    return previous_factors(len(order) - 1 - order, common, least)[::-1]


def string_hashes(
    raw: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int, most: int
) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the strings from ``begin`` to ``end``, of ``least`` to ``most`` bytes."""
    doublings = least.bit_length() - 1
    h, step = _grams(raw, doublings), 1 << doublings
    length = (end - begin).astype(np.uint64)
    a, b = mix(length), mix(length + np.uint64(9))
    for j in range(-(-most // step)):
        part = h[np.minimum(begin + j * step, end - step)]
        a = mix(a * np.uint64(31) + part)
        b = mix(b * np.uint64(1_000_003) + (part ^ np.uint64(0x5555)))
    return a.view(np.int64), b.view(np.int64)


def shared_by_several(a: np.ndarray, b: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which strings, given by their hashes, more than one owner has."""
    order = np.lexsort((b, a))
    a, b, owner = a[order], b[order], owner[order]
    fresh = np.ones(len(a), dtype=bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(fresh)
    several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
    out = np.empty(len(a), dtype=bool)
    out[order] = several[np.cumsum(fresh) - 1]
    return out


def _ranges(flags: np.ndarray) -> list[dict]:
    """First and last-but-one of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _united(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Ranges that overlap or touch as one, in order."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = starts[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    return [
        {"start": int(a), "end": int(b)}
        for a, b in zip(starts[first], reach[last], strict=True)
    ]


def matched_suffixes(
    contents: list[bytes], counts: np.ndarray, owners: np.ndarray, rule: Rule
) -> tuple[list[list[dict]], list[list[dict]], list[list[dict]]]:
    """Per stretch, the suffixes of ``min_bytes`` that match any other and those that match
    an earlier one, and the bytes of passages that match another owner's.

    Stretches come in corpus order; ``counts`` are their numbers of suffixes, ``owners``
    their documents.
    """
    raw = np.frombuffer(_END.join(contents) + _END, dtype=np.uint8)
    sizes = np.array([len(c) for c in contents])
    begins = np.cumsum(sizes + 1) - sizes - 1
    offsets = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(counts)), counts)
    positions = begins[row] - offsets[row] + np.arange(len(row))
    suffixes = Suffixes(raw, positions, rule.min_bytes)
    common = suffixes.common()
    complete = positions + rule.min_bytes <= begins[row] + sizes[row]
    earlier = previous_factors(suffixes.order, common, rule.min_bytes) >= rule.min_bytes
    later = next_factors(suffixes.order, common, rule.min_bytes) >= rule.min_bytes
    earlier &= complete
    matched = (earlier | later) & complete

    text = np.frombuffer(b"".join(contents), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    begin, end = rule.passages(text, bounds, sizes < counts + rule.min_bytes - 1)
    of = np.searchsorted(bounds, begin, "right") - 1
    mine = begin - bounds[of] < counts[of]
    begin, end, of = begin[mine], end[mine], of[mine]
    if len(begin):
        hashes = string_hashes(text, begin, end, rule.deal_bytes, rule.min_bytes)
        # Stretches of several documents have a negative owner of their own.
        repeated = shared_by_several(*hashes, owners[of]) | (owners[of] < 0)
        begin, end, of = begin[repeated], end[repeated], of[repeated]
    at, end = begin - bounds[of] + 1, end - bounds[of]
    cut = np.searchsorted(of, np.arange(len(counts) + 1))
    out = ([], [], [])
    for k, (a, b) in enumerate(zip(offsets.tolist(), (offsets + counts).tolist(), strict=True)):
        out[0].append(_ranges(matched[a:b]))
        out[1].append(_ranges(earlier[a:b]))
        out[2].append(_united(at[cut[k] : cut[k + 1]], end[cut[k] : cut[k + 1]]))
    return out


_RANGE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SQL_RANGE = "array<struct<start:int,end:int>>"
_MATCHED = (
    f"least long, content long, matched {_SQL_RANGE}, earlier {_SQL_RANGE}, "
    f"passages {_SQL_RANGE}"
)


def _match_task(rule: Rule):
    """Sort the suffixes of whole groups, several groups at a time.

    Rows arrive ordered by ``least`` and corpus order. Stretches that several documents
    hold are an owner of their own.
    """

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        least, content, counts, data, owner = zip(*rows, strict=True)
        owners = np.array([-k - 1 if o is None else o for k, o in enumerate(owner)])
        found = matched_suffixes(list(data), np.array(counts), owners, rule)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(least, pa.int64()),
                pa.array(content, pa.int64()),
                *(pa.array(ranges, _RANGE) for ranges in found),
            ],
            names=["least", "content", "matched", "earlier", "passages"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        names = ("least", "content", "n", "data", "owner")
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if rows and row[:2] == rows[-1][:2]:
                    continue  # a row of the corpus that was given twice
                if size >= _TASK_BYTES and row[0] != rows[-1][0]:
                    yield settle(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield settle(rows)

    return run


def _window_rows(rule: Rule):
    """Two hashes of every string of ``min_bytes`` and of every passage of the stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = np.frombuffer(row["data"], np.uint8)
                whole = np.arange(max(0, min(row["n"], len(raw) - rule.min_bytes + 1)))
                ended = np.array([len(raw) < row["n"] + rule.min_bytes - 1])
                begin, end = rule.passages(raw, np.array([0, len(raw)]), ended)
                begin, end = begin[begin < row["n"]], end[begin < row["n"]]
                found = []
                for at, until, least, passage in (
                    (whole, whole + rule.min_bytes, rule.min_bytes, False),
                    (begin, end, rule.deal_bytes, True),
                ):
                    if len(at):
                        hashes = string_hashes(raw, at, until, least, rule.min_bytes)
                        found.append((at, until - at, passage, hashes))
                kind = batch.column("place").type
                for at, lengths, passage, (a, b) in found:
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, row["least"])),
                            pa.array(np.full(n, row["content"])),
                            pa.array(at.astype(np.int32)),
                            pa.array(lengths.astype(np.int32)),
                            pa.array(np.full(n, passage)),
                            pa.array(a),
                            pa.array(b),
                            pa.array([row["owner"]] * n, pa.int64()),
                            pa.array([row["place"]] * n, kind),
                        ],
                        names=[
                            "least", "content", "i", "size", "passage", "a", "b", "owner", "place"
                        ],
                    )

    return run


def _matched_in_large(large: DataFrame, rule: Rule) -> DataFrame:
    """The same ranges for groups of too many stretches, from counts of window hashes.

    Equal windows are counted with map-side combining, so no group meets in one task.
    """
    kind = large.schema["place"].dataType.simpleString()
    windows = large.mapInArrow(
        _window_rows(rule),
        "least long, content long, i int, size int, passage boolean, a long, b long, "
        f"owner long, place {kind}",
    )
    windows = materialise(windows, "windows")
    place = F.struct("place", "i")
    # Without an owner a stretch belongs to several documents.
    shared = F.max(F.col("owner").isNull()) | (F.min("owner") != F.max("owner"))
    again = (
        windows.groupBy("least", "passage", "a", "b")
        .agg(
            F.count("*").alias("_n"),
            F.min(place).alias("_first"),
            F.coalesce(shared, F.lit(True)).alias("_foreign"),
        )
        .where("CASE WHEN passage THEN _foreign ELSE _n > 1 END")
    )
    hits = windows.join(again, ["least", "passage", "a", "b"]).select(
        "least", "content", "i", "size", "passage", (F.col("_first") != place).alias("later")
    )

    def ranges(of: Column, start: Column, end: Column) -> Column:
        found = F.collect_list(F.when(of, F.struct(start.alias("start"), end.alias("end"))))
        return F.array_sort(found).cast(_SQL_RANGE)

    # A stretch has STRETCH suffixes at most, so these lists are short.
    i, string = F.col("i"), ~F.col("passage")
    return hits.groupBy("least", "content").agg(
        ranges(string, i, i + 1).alias("matched"),
        ranges(string & F.col("later"), i, i + 1).alias("earlier"),
        ranges(F.col("passage"), i + 1, i + F.col("size")).alias("passages"),
    )


# --- operator ---------------------------------------------------------------------


def _cut_stretches(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = column_bytes(batch.column("text"))
            out: dict[str, list] = {"least": [], "content": [], "n": [], "data": []}
            size = 0
            for row, wanted in enumerate(batch.column("wanted")):
                for w in wanted.as_py():
                    start = int(bounds[row]) + w["at"]
                    end = min(start + w["n"] + rule.min_bytes - 1, int(bounds[row + 1]))
                    out["least"].append(w["least"])
                    out["content"].append(w["content"])
                    out["n"].append(w["n"])
                    out["data"].append(raw[start:end].tobytes())
                    size += end - start
                    if size > 4_000_000:
                        yield _cut_rows(out)
                        out, size = {name: [] for name in out}, 0
            yield _cut_rows(out)

    return run


def _cut_rows(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"least": pa.int64(), "content": pa.int64(), "n": pa.int32(), "data": pa.binary()}
    arrays = [pa.array(out[name], kind) for name, kind in kinds.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(kinds))


def _bounds_of(ranges: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    ranges = ranges or []
    return tuple(np.array([r[side] for r in ranges], dtype=np.int64) for side in ("start", "end"))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the marked bytes out of every text, a few megabytes of rows at a time."""
    for batch in batches:
        raw, bounds = column_bytes(batch.column("text"))
        rows: list[tuple] = []
        size = 0
        columns = (batch.column(c) for c in ("doc_id", "marked", "passages"))
        for row, (doc_id, marked, passages) in enumerate(zip(*columns, strict=True)):
            start, end = int(bounds[row]), int(bounds[row + 1])
            spans = _united(*_bounds_of(marked.as_py()))
            kept, at = [], start
            for span in spans:
                kept.append(raw[at : start + span["start"]])
                at = start + span["end"]
            kept.append(raw[at:end])
            told = _united(*_bounds_of(passages.as_py()))
            rows.append((doc_id.as_py(), end - start, b"".join(kept), spans, told))
            size += end - start
            if size > 8_000_000:
                yield _stripped(rows)
                rows, size = [], 0
        yield _stripped(rows)


def _stripped(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in range(5))
    kinds = (pa.int64(), pa.int64(), pa.binary(), _RANGE, _RANGE)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)],
        names=["doc_id", "n_bytes", "kept", "spans", "passages"],
    )


def _same_row(doc_id: str = "_id", key: str = "_k") -> Column:
    return F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.col("_key") == F.col(key))


def _marked(
    keyed: DataFrame, rule: Rule, keep_first: bool, most_stretches: int
) -> DataFrame:
    """``doc_id, _key, marked, passages``: the byte ranges of each text to remove, and
    those of repeated passages."""
    spark = keyed.sparkSession
    rows = materialise(keyed.mapInArrow(_stretch_rows(rule), _STRETCH), "stretches")
    shared = (
        rows.groupBy("least")
        .agg(F.count("*").alias("_n"), F.max("inner").alias("_inner"))
        .where("_n > 1 OR _inner")
        .select("least")
    )
    rows = materialise(rows.join(shared, "least", "left_semi"), "shared")
    place = F.struct("doc_id", "_key", "at")
    who = F.xxhash64("doc_id", "_key").bitwiseAND((1 << 63) - 1)
    contents = materialise(
        rows.groupBy("least", "content").agg(
            F.count("*").alias("times"),
            F.min(place).alias("place"),
            F.first("n").alias("n"),
            F.max("inner").alias("inner"),
            F.when(F.min(who) == F.max(who), F.min(who)).alias("owner"),
        ),
        "contents",
    )
    # Equal stretches count as one from here on; only different ones are compared.
    groups = contents.groupBy("least").agg(
        F.count("*").alias("_n"), F.max("inner").alias("_inner")
    )
    groups = materialise(groups.where("_n > 1 OR _inner").select("least", "_n"), "groups")
    compared = contents.join(groups, "least").select(
        "least", "content", "place", "n", "owner", "_n"
    )
    wanted = compared.groupBy(
        F.col("place.doc_id").alias("_id"), F.col("place._key").alias("_k")
    ).agg(F.collect_list(F.struct("least", "content", F.col("place.at").alias("at"), "n")).alias("wanted"))
    cut = (
        keyed.join(wanted, _same_row())
        .select("text", "wanted")
        .mapInArrow(_cut_stretches(rule), "least long, content long, n int, data binary")
    )
    cut = materialise(cut, "cut")
    placed = cut.join(
        compared.select("least", "content", "place", "owner", "_n"), ["least", "content"]
    )
    volume = cut.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    small = (
        placed.where(F.col("_n") <= most_stretches)
        .repartition(task_count(spark, volume, 32_000_000), "least")
        .sortWithinPartitions("least", "place")
        .select("least", "content", "n", "data", "owner")
        .mapInArrow(_match_task(rule), _MATCHED)
    )
    large = placed.where(F.col("_n") > most_stretches).select(
        "least", "content", "n", "data", "place", "owner"
    ).dropDuplicates(["least", "content"])
    found = materialise(small.unionByName(_matched_in_large(large, rule)), "matched")

    def range_of(start: Column | str, end: Column | str) -> Column:
        one = F.struct(F.lit(0).alias("start") if start == 0 else F.col(start).alias("start"),
                       F.col(end).alias("end"))
        return F.array(one).cast(_SQL_RANGE)

    none = F.array().cast(_SQL_RANGE)
    first = place.eqNullSafe(F.col("_first"))
    everything = ~first if keep_first else F.col("times") > 1
    known = contents.where("times > 1").select("least", "content").unionByName(
        found.select("least", "content")
    )
    held = contents.select(
        "least", "content", "times", F.col("place").alias("_first"), F.col("owner").isNull().alias("_many")
    )
    told = known.distinct().join(held, ["least", "content"]).join(found, ["least", "content"], "left")
    gone = (
        F.when(everything & (F.col("whole") > 0), range_of(0, "whole"))
        .when(everything, none)
        .otherwise(F.coalesce("earlier" if keep_first else "matched", none))
    )
    passages = (
        F.when(F.col("_many") & (F.col("p_from") >= 0), range_of("p_from", "p_to"))
        .when(F.col("_many"), none)
        .otherwise(F.coalesce("passages", none))
    )
    at = F.col("at")

    def moved(ranges: Column, longer: int) -> Column:
        return F.transform(
            ranges,
            lambda r: F.struct(
                (at + r["start"]).alias("start"), (at + r["end"] + longer).alias("end")
            ),
        )

    return (
        rows.join(told, ["least", "content"])
        .select(
            "doc_id",
            "_key",
            moved(gone, rule.min_bytes - 1).alias("gone"),
            moved(passages, 0).alias("passages"),
        )
        .where("size(gone) + size(passages) > 0")
        .groupBy("doc_id", "_key")
        .agg(
            F.flatten(F.collect_list("gone")).alias("marked"),
            F.flatten(F.collect_list("passages")).alias("passages"),
        )
    )


def remove_repeats(
    docs: DataFrame,
    min_bytes: int = MIN_BYTES,
    keep_first: bool = True,
    most_stretches: int = MOST_STRETCHES,
    id_column: str = "doc_id",
    text_column: str = "text",
    passage_words: int = PASSAGE_WORDS,
    passage_bytes: int = DEAL_BYTES,
) -> DataFrame:
    """Remove the bytes of every string of ``min_bytes`` bytes that occurs elsewhere.

    Texts are UTF-8 bytes and matches lie within one text each. With ``keep_first`` only
    later copies go: bytes covered by a match with an earlier place, in the order of (id,
    text hash, offset). Without it every copy goes. All matches are judged on the input.

    Repeated passages that are too short to be removed are told: those of
    ``passage_words`` words, from one separator on, that take ``passage_bytes`` at least
    and occur in another document too.

    Suffixes are dealt out in stretches by the smallest gram hash of their first bytes.
    Equal stretches are merged before their bytes are moved, so a passage that a third of
    all documents share travels once. Each task puts the suffixes of its groups in order,
    takes the common prefixes of neighbours, and from the previous and next smaller
    positions the longest earlier match of each suffix; the mirror of that is the longest
    later one. A suffix is repeated when either reaches ``min_bytes``. Groups of more than
    ``most_stretches`` different stretches are compared by window hashes instead, spread
    over all tasks. Long texts are worked through in overlapping parts.

    Returns ``doc_id, n_bytes, kept, spans, passages``, one row per row given: the bytes
    left, the maximal removed runs and the maximal runs of repeated passages as byte
    ranges. A null text is empty; shorter ones than ``min_bytes`` stay. Two rows equal in
    id and text are copies of each other and are answered alike: they keep their text with
    ``keep_first`` only if no earlier one has it; for passages they are one document. No
    rows in, no rows out.
    """
    if min_bytes < 16 or min(min_bytes, passage_bytes) < 16:
        raise ValueError("min_bytes and passage_bytes must be at least 16")
    rule = Rule(min_bytes, passage_words, passage_bytes)
    keyed = texts(docs, id_column, text_column).withColumn("_key", text_key(F.col("text")))
    marked = _marked(keyed, rule, keep_first, most_stretches)
    marked = materialise(marked, "marked").withColumnsRenamed({"doc_id": "_id", "_key": "_k"})
    return (
        keyed.join(marked, _same_row(), "left")
        .select("doc_id", "text", "marked", "passages")
        .mapInArrow(
            _strip,
            f"doc_id long, n_bytes long, kept binary, spans {_SQL_RANGE}, passages {_SQL_RANGE}",
        )
    )
