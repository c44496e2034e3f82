"""JSON array files cut into their objects by many tasks.

A file is read in byte blocks, split at closing braces. Whether a block begins inside a
string, and how deep, depends on all blocks before it; what a block does to that state can
be said without knowing it, for either kind of start. A scan over one small row per block
then gives every block its start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, ship_package, temporary_conf

_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_BLOCK = "file string, block long, flips int, outer_delta long, outer_least long, inner_delta long, inner_least long"
_CUT = "owner long, part long, seq long, whole boolean, value string"


def _opened(piece: bytes) -> tuple[int, int, int]:
    """Quotes in a piece, and braces opened in it if it starts outside or inside a string."""
    if b"\\" in piece:
        piece = _ESCAPED.sub(b"", piece)
    if b'"' not in piece:
        n = piece.count(b"{")
        return 0, n, 0
    parts = piece.split(b'"')
    outside = sum(part.count(b"{") for part in parts[::2])
    inside = sum(part.count(b"{") for part in parts[1::2])
    return len(parts) - 1, outside, inside


@dataclass
class _Effect:
    """What a block does, for one kind of start: end inside a string, change and least depth."""

    inside: bool
    depth: int = 0
    least: int = 0

    def add(self, quotes: int, outside: int, within: int) -> None:
        self.depth += within if self.inside else outside
        self.inside ^= quotes % 2 == 1
        if not self.inside:  # the brace that ends the piece
            self.depth -= 1
            self.least = min(self.least, self.depth)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("file", "block", "value"))
        for file, block, value in zip(*columns, strict=True):
            yield (file, block), value


def _summary_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of the task."""
    found: dict[tuple[str, int], tuple[_Effect, _Effect]] = {}
    for key, piece in _by_block(batches):
        outer, inner = found.setdefault(key, (_Effect(False), _Effect(True)))
        counted = _opened(piece)
        outer.add(*counted)
        inner.add(*counted)
    rows = [
        (*key, int(outer.inside), outer.depth, outer.least, inner.depth, inner.least)
        for key, (outer, inner) in found.items()
    ]
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    if rows:
        columns = [pa.array(c) for c in zip(*rows, strict=True)]
        columns[2] = columns[2].cast(pa.int32())
        yield pa.RecordBatch.from_arrays(columns, names=names)


@dataclass
class _Start:
    """How a block begins: its number, depth, whether in a string, the block that holds the
    beginning of the object it is in, and whether it is its file's first or last."""

    number: int
    depth: int
    inside: bool
    owner: int
    first: bool
    last: bool


def scan_blocks(rows: list[dict]) -> dict[tuple[str, int], _Start]:
    """The start of every block, from the blocks' effects in file order."""
    starts: dict[tuple[str, int], _Start] = {}
    depth, inside, owner, file = 0, False, 0, None
    rows = sorted(rows, key=lambda row: (row["file"], row["block"]))
    for number, row in enumerate(rows):
        first = row["file"] != file
        last = number + 1 == len(rows) or rows[number + 1]["file"] != row["file"]
        if first:
            depth, inside, file = 0, False, row["file"]
        starts[row["file"], row["block"]] = _Start(number, depth, inside, owner, first, last)
        side = "inner" if inside else "outer"
        closed = depth == 0 or depth + row[f"{side}_least"] <= 0
        depth += row[f"{side}_delta"]
        inside ^= bool(row["flips"])
        if closed:
            owner = number
        # What follows the last brace of a file was counted as if a brace ended it.
        if last and (inside or depth != -1):
            raise ValueError(f"{file} is no JSON array of objects")
    return starts


def _cut_block(pieces: Iterator[bytes], start: _Start, file: str) -> Iterator[tuple]:
    """``owner, part, seq, whole, value`` for the objects of a block and for the pieces of
    those that it shares with others."""

    def wrong() -> ValueError:
        return ValueError(f"{file} is no JSON array of objects")

    depth, inside, owner, seq = start.depth, start.inside, start.owner, 0
    shared = depth > 0
    text: list[bytes] = []
    waiting = next(pieces, None)
    while waiting is not None:
        piece, waiting = waiting, next(pieces, None)
        if waiting is None and start.last:
            # Behind the last object; a file without objects is this piece alone.
            rest = b"".join(piece.split())
            if depth or inside or rest != (b"[]" if start.first and not seq else b"]"):
                raise wrong()
            return
        if not depth:
            at = piece.find(b"{")
            lead = b"[" if start.first and not seq else b","
            if at < 0 or piece[:at].strip() != lead:
                raise wrong()
            piece, owner, shared = piece[at:], start.number, False
        quotes, outside, within = _opened(piece)
        depth += within if inside else outside
        inside ^= quotes % 2 == 1
        text.append(piece + b"}")
        if not inside:
            depth -= 1
            if depth < 0:
                raise wrong()
            if not depth:
                yield owner, start.number, seq, not shared, b"".join(text)
                text, seq = [], seq + 1
    if text:
        yield owner, start.number, seq, False, b"".join(text)


def _cut_task(starts: dict[tuple[str, int], _Start]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for (file, block), pieces in _grouped(_by_block(batches)):
            if (file, block) not in starts:
                raise ValueError(f"{file} changed while it was read")
            for row in _cut_block(pieces, starts[file, block], file):
                rows.append(row)
                size += len(row[4])
                if size > 4_000_000:
                    yield _cut_rows(rows)
                    rows, size = [], 0
        if rows:
            yield _cut_rows(rows)

    return run


def _cut_rows(rows: list[tuple]) -> pa.RecordBatch:
    owner, part, seq, whole, value = zip(*rows, strict=True)
    columns = [
        *(pa.array(c, pa.int64()) for c in (owner, part, seq)),
        pa.array(whole, pa.bool_()),
        pa.array(value, pa.binary()).cast(pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _CUT.split(", ")])


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """Neighbouring rows of one block as one group, a row at a time."""
    ahead = next(rows, None)

    def group(key) -> Iterator[bytes]:
        nonlocal ahead
        while ahead is not None and ahead[0] == key:
            value = ahead[1]
            ahead = next(rows, None)
            yield value

    while ahead is not None:
        key = ahead[0]
        values = group(key)
        yield key, values
        for _ in values:  # whatever was left
            pass


def read_array_objects(spark: SparkSession, path: str) -> DataFrame:
    """``pos, value``: the objects of JSON array files as texts, in file order (runs jobs).

    ``path`` is a file or a folder of files, taken by name. ``pos`` grows along them but
    has gaps. Blocks of a file are read by as many tasks as Spark gives it, twice: first
    for what each does to quotes and depth, one row a block, which the driver scans; then
    to cut out the objects. The few objects that lie across blocks are put together
    afterwards. A file that is no array of objects is an error.
    """
    ship_package(spark)
    slots = str(max(1, spark.sparkContext.defaultParallelism))
    key = "spark.sql.files.minPartitionNum"
    # Both passes must see the same blocks, though executors may come and go.
    with temporary_conf(spark, {key: spark.conf.get(key, None) or slots}):
        pieces = (
            spark.read.option("lineSep", "}")
            .text(path)
            .select(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.col("value").cast("binary").alias("value"),
            )
        )
        blocks = pieces.mapInArrow(_summary_task, _BLOCK).collect()
        starts = scan_blocks([row.asDict() for row in blocks])
        cut = materialise(pieces.mapInArrow(_cut_task(starts), _CUT), "objects")
    whole = cut.where("whole").select("owner", "seq", "value")
    # At most one object is open where a block ends, so its first block names it.
    shared = (
        cut.where("NOT whole")
        .groupBy("owner")
        .agg(F.array_sort(F.collect_list(F.struct("part", "value"))).alias("_parts"))
        .select(
            "owner",
            F.lit((1 << 33) - 1).alias("seq"),
            F.array_join(F.transform("_parts", lambda p: p["value"]), "").alias("value"),
        )
    )
    return whole.unionByName(shared).select(
        (F.shiftleft("owner", 33) + F.col("seq")).alias("pos"), "value"
    )
