"""Words of whole texts as 64-bit numbers, a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text taken in one numpy pass, which needs some fifty times as much memory.
PASS_BYTES = 1_000_000


def _letter_values(separators: bytes) -> np.ndarray:
    """One odd 64-bit number per byte, the same for A-Z and a-z; 0 for separators."""
    values = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
    values = values * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    values[list(separators)] = 0
    return values


SPACES = bytes([0x20, *range(0x09, 0x0E)])
# Whatever is ASCII and neither letter nor digit; bytes of longer characters are letters.
PUNCTUATION = bytes(b for b in range(128) if not chr(b).isalnum())
BY_SPACE = _letter_values(SPACES)
BY_PUNCTUATION = _letter_values(PUNCTUATION)

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the information of 64-bit numbers over all their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number modulo 2**64, as far as they were asked for."""

    def __init__(self) -> None:
        self.table = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            steps = np.full(max(n, 1024), _STEP, dtype=np.uint64)
            steps[0] = 1
            self.table = np.multiply.accumulate(steps)
        return self.table


_POWERS = _Powers()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), bounds - bounds[0]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


def pieces(batch: pa.RecordBatch, column: str, size: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch with about ``size`` bytes of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def overlapping(
    column: pa.Array, size: int, overlap: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
    """Bytes, bounds, row numbers, the place of the first byte in its text, how many bytes
    belong to each part, and whether its text ends there.

    Texts longer than ``size`` come in parts that share ``overlap`` bytes: the bytes behind
    those that belong to a part are there to be looked at.
    """
    raw, bounds = column_bytes(column)
    first = 0
    while first < len(column):
        stop = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        begin, end = int(bounds[first]), int(bounds[stop])
        rows = np.arange(first, stop)
        if end - begin <= size + overlap:
            part = bounds[first : stop + 1] - begin
            yield raw[begin:end], part, rows, 0, np.diff(part), np.ones(len(rows), dtype=bool)
        else:
            for at in range(begin, end, size):
                until = min(at + size + overlap, end)
                own = np.array([min(size, end - at)])
                ended = np.array([until == end])
                yield raw[at:until], np.array([0, until - at]), rows, at - begin, own, ended
        first = stop


def segments(
    column: pa.Array, values: np.ndarray, size: int = PASS_BYTES
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, bounds and row numbers of about ``size`` bytes of text at a time.

    Texts that are longer are cut before a separator, a byte whose value is 0, and come
    as several segments with the same row number; only a word can be longer than that.
    """
    raw, bounds = column_bytes(column)
    first = 0
    while first < len(column):
        stop = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        if bounds[stop] - bounds[first] <= size:
            part = raw[bounds[first] : bounds[stop]]
            yield part, bounds[first : stop + 1] - bounds[first], np.arange(first, stop)
        else:
            at, end = int(bounds[first]), int(bounds[stop])
            while at < end:
                cut = end
                for ahead in range(at + size, end, size):
                    free = np.flatnonzero(values[raw[ahead : min(ahead + size, end)]] == 0)
                    if len(free):
                        cut = ahead + int(free[0])
                        break
                yield raw[at:cut], np.array([0, cut - at]), np.array([first])
                at = cut
        first = stop


def words(
    raw: np.ndarray, bounds: np.ndarray, values: np.ndarray = BY_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start bytes and hashes of all words, and which words belong to which text.

    Text i has words ``of[i]`` to ``of[i + 1]``.
    """
    solid = values[raw] != 0
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts[heads] = solid[heads]
    starts = np.flatnonzero(starts)
    of = np.searchsorted(starts, bounds)
    if not len(starts):
        return starts, np.empty(0, np.uint64), of
    spans = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, spans)
    powers = _POWERS(int(spans.max()))
    coded = values[raw[starts[0] :]]
    coded *= powers[place]
    # Separators count 0, so a word may run on to the next word's start.
    return starts, mix(np.add.reduceat(coded, starts - starts[0])), of


def shingles(hashes: np.ndarray, of: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingles of ``size`` words per text.

    A text with fewer words is one shingle of all of them; one without words has none.
    """
    factors = _POWERS(size + 8)[1 : size + 1]
    n = max(0, len(hashes) - size + 1)
    grams = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        grams += hashes[j : j + n] * factors[j]
    grams = mix(grams)
    out = []
    for start, end in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        count = end - start
        if count >= size:
            out.append(np.unique(grams[start : end - size + 1]))
        elif count:
            whole = (hashes[start:end] * factors[:count]).sum(dtype=np.uint64)
            out.append(mix(np.array([whole ^ np.uint64(count)], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def shingle_sets(
    column: pa.Array, size: int, limit: int = PASS_BYTES
) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and shingle sets of about ``limit`` bytes of whole texts at a time, in order.

    A longer text is read in segments, the last ``size - 1`` words of each leading the next,
    so that it needs memory for itself and its shingles only.
    """
    none = np.empty(0, dtype=np.uint64)
    row, lead, found = -1, none, []

    def whole() -> list[np.ndarray]:
        if found:
            return [np.unique(np.concatenate(found)) if len(found) > 1 else found[0]]
        return shingles(lead, np.array([0, len(lead)]), size)

    for raw, bounds, rows in segments(column, BY_SPACE, limit):
        _, hashes, of = words(raw, bounds)
        if row >= 0 and rows[0] != row:
            yield row, whole()
            row, lead, found = -1, none, []
        if len(rows) > 1:
            yield int(rows[0]), shingles(hashes, of, size)
            continue
        row = int(rows[0])
        hashes = np.concatenate([lead, hashes])
        if len(hashes) >= size:
            found.append(shingles(hashes, np.array([0, len(hashes)]), size)[0])
        lead = hashes[max(0, len(hashes) - size + 1) :]
    if row >= 0:
        yield row, whole()


def prefixes(
    raw: np.ndarray, starts: np.ndarray, sizes: tuple[int, ...], values: np.ndarray
) -> np.ndarray:
    """Hashes of the first so many bytes of every word, one column per size; 0 for words
    that are not longer than that."""
    out = np.zeros((len(starts), len(sizes)), dtype=np.uint64)
    total = np.zeros(len(starts), dtype=np.uint64)
    whole = np.ones(len(starts), dtype=bool)
    padded = np.append(values[raw], np.zeros(max(sizes) + 1, dtype=np.uint64))
    for k in range(max(sizes) + 1):
        value = padded[starts + k]
        whole &= value != 0
        if k in sizes:
            out[:, sizes.index(k)] = np.where(whole, mix(total + np.uint64(k)), 0)
        total += value * _POWERS(max(sizes) + 1)[k]
    return out
