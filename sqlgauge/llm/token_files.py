"""Token-id files with succinct document boundaries.

A file is one byte string, all numbers little-endian:

    8 bytes   magic "TOKIDS01"
    8 x 8     documents, ids, bytes per id, low bits, and the lengths in bytes of the
              sections low, high and directory, and 0
    low       the low bits of each boundary, packed
    high      unary gaps of the high bits: boundary i sets bit (boundary >> low) + i
    directory position of every 64th set bit of ``high``, 8 bytes each
    ids       the ids of all documents one after another, 2 or 4 bytes each

Boundaries are the running totals after each document (Elias-Fano coded), so document i
lies between boundary i-1 and boundary i. A document's doc_id is not in the file: the
table of files gives it with the document's place.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, new_path
from .common import task_count

MAGIC = b"TOKIDS01"
_HEADER = 8 + 8 * 8
_SAMPLE = 64
# Bytes of text that one Python pass turns into ids, and that one task writes.
_PASS_BYTES = 6_000_000
_TASK_BYTES = 48_000_000
# Words whose ids a worker remembers, some 200 bytes each.
_KNOWN_WORDS = 250_000


# --- Elias-Fano -------------------------------------------------------------------


def encode_boundaries(ends: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Low-bit count, packed low bits, high bits and select directory of growing numbers."""
    ends = np.asarray(ends, dtype=np.uint64)
    n = len(ends)
    universe = int(ends[-1]) + 1 if n else 1
    low = max(0, (universe // n).bit_length() - 1) if n else 0
    if low:
        bits = (ends[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    else:
        packed = b""
    ones = (ends >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros((int(ones[-1]) if n else 0) + 1, dtype=np.uint8)
    high[ones] = 1
    directory = ones[::_SAMPLE].astype("<u8").tobytes()
    return low, packed, np.packbits(high, bitorder="little").tobytes(), directory


class Section:
    """Bytes of a file that are read when they are cut out."""

    def __init__(self, read: Callable[[int, int], bytes], start: int, size: int):
        self._read, self._start, self._size = read, start, size

    def __len__(self) -> int:
        return self._size

    def __getitem__(self, cut: slice) -> bytes:
        start, stop, _ = cut.indices(self._size)
        return self._read(self._start + start, max(0, stop - start))


class Boundaries:
    """Reads single boundaries, or a range of them, out of the coded form without the rest.

    The three parts are bytes, or sections of a file.
    """

    def __init__(
        self,
        n: int,
        low: int,
        packed: bytes | Section,
        high: bytes | Section,
        directory: bytes | Section,
    ):
        self.n, self.low = n, low
        self._packed, self._high, self._directory = packed, high, directory

    def select(self, i: int) -> int:
        """Position of set bit number ``i`` of the high bits."""
        sample = 8 * (i // _SAMPLE)
        start = int.from_bytes(self._directory[sample : sample + 8], "little")
        wanted = i % _SAMPLE
        byte = start // 8
        # The sampled bit itself counts as number 0; earlier bits of its byte do not.
        skip = start % 8
        while True:
            chunk = np.frombuffer(self._high[byte : byte + 64], np.uint8)
            bits = np.unpackbits(chunk, bitorder="little")
            bits[:skip] = 0
            found = np.flatnonzero(bits)
            if wanted < len(found):
                return byte * 8 + int(found[wanted])
            wanted -= len(found)
            byte, skip = byte + 64, 0

    def end(self, i: int) -> int:
        """Where document ``i`` ends; document -1 ends at 0."""
        return int(self.range(i, i + 1)[0]) if i >= 0 else 0

    def range(self, first: int, last: int) -> np.ndarray:
        """Where documents ``first`` to ``last - 1`` end, between two selects."""
        if first >= last:
            return np.empty(0, dtype=np.int64)
        begin, stop = self.select(first), self.select(last - 1)
        byte = begin // 8
        chunk = np.frombuffer(self._high[byte : stop // 8 + 1], np.uint8)
        bits = np.unpackbits(chunk, bitorder="little")
        ones = np.flatnonzero(bits[begin % 8 : stop - 8 * byte + 1]) + begin
        high = (ones - np.arange(first, last)).astype(np.int64)
        if not self.low:
            return high
        at, until = first * self.low, last * self.low
        packed = np.frombuffer(self._packed[at // 8 : (until + 7) // 8], np.uint8)
        cut = np.unpackbits(packed, bitorder="little")[at % 8 : at % 8 + until - at]
        cut = cut.reshape(last - first, self.low).astype(np.int64)
        return (high << self.low) | (cut << np.arange(self.low)).sum(axis=1)


# --- files ------------------------------------------------------------------------


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system a path lies in, as the executors' Python sees it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_file(path: str, lengths: np.ndarray, ids: Sequence[np.ndarray], width: int) -> None:
    """Write one file under a name of its own and move it into place when it is whole,
    so a task that is lost, repeated or run twice leaves the same complete file."""
    ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
    low, packed, high, directory = encode_boundaries(ends)
    total = int(ends[-1]) if len(ends) else 0
    numbers = [len(ends), total, width, low, len(packed), len(high), len(directory), 0]
    store, place = open_store(path)
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    partial = f"{place}.{uuid.uuid4().hex}.partial"
    with store.open_output_stream(partial) as out:
        out.write(MAGIC + np.array(numbers, dtype="<u8").tobytes())
        for section in (packed, high, directory, *(np.ascontiguousarray(x).data for x in ids)):
            out.write(section)
    store.move(partial, place)


class TokenFile:
    """Random access to one file."""

    def __init__(self, path: str):
        store, place = open_store(path)
        self._in = store.open_input_file(place)
        head = self._read(0, _HEADER)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is not a token-id file")
        numbers = np.frombuffer(head[8:], "<u8").astype(int)
        self.documents, self.ids, self.width, low, a, b, c, _ = (int(x) for x in numbers)
        parts = [
            Section(self._read, at, size)
            for at, size in ((_HEADER, a), (_HEADER + a, b), (_HEADER + a + b, c))
        ]
        self.boundaries = Boundaries(self.documents, low, *parts)
        self._start = _HEADER + a + b + c

    def _read(self, at: int, n: int) -> bytes:
        self._in.seek(at)
        data = self._in.read(n)
        if len(data) != n:
            raise ValueError("token-id file is cut short")
        return data

    def between(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file."""
        data = self._read(self._start + start * self.width, (end - start) * self.width)
        return np.frombuffer(data, f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        """The ids of document ``i``, by two selects and one read."""
        return self.between(self.boundaries.end(i - 1), self.boundaries.end(i))

    def close(self) -> None:
        self._in.close()


# --- encoding ---------------------------------------------------------------------

Encoder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


class WordwiseEncoder:
    """Token ids of whole texts with each different word of a batch encoded once.

    For byte-level vocabularies a piece never reaches across a blank that follows a
    character other than white space. Texts are cut before each blank, the different cuts
    are encoded together, and their ids are put in order by numpy. Texts in which a blank
    meets other white space, or which hold a special token, are encoded whole.
    """

    def __init__(self, path: str):
        # The tasks are the parallel work; threads of the library's own would only wait.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Each word is asked for once, so the library's cache would only be filled.
        resize = getattr(self.tokenizer.model, "_resize_cache", None)
        if resize is not None:
            resize(0)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self._leads = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, number in vocabulary.items():
            self._leads[number] = token.startswith("Ġ")
        added = self.tokenizer.get_added_tokens_decoder().values()
        self._special = [token.content for token in added]
        self._known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for at in range(0, len(texts), 64):  # an encoding is far larger than its ids
            found = self.tokenizer.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)
            out.extend(np.array(x.ids, dtype=f"<u{self.width}") for x in found)
        return out

    def _words(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids, and how many each word has, of words with a blank in front of them."""
        ids, sizes = [], []
        groups = [words[i : i + 500] for i in range(0, len(words), 500)]
        joined = self._whole([" " + " ".join(group) for group in groups])
        for group, found in zip(groups, joined, strict=True):
            starts = np.flatnonzero(self._leads[found])
            if len(starts) != len(group) or starts[0] != 0:
                single = self._whole([" " + w for w in group])
                found, sizes_ = np.concatenate(single), np.array([len(x) for x in single])
            else:
                sizes_ = np.diff(np.append(starts, len(found)))
            ids.append(found)
            sizes.append(sizes_)
        return ids, sizes

    def _recalled(
        self, words: list[str], often: np.ndarray
    ) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The same, with words that came more than once in a pass kept for the next ones."""
        codes = [self._known.get(w) for w in words]
        fresh = [i for i, code in enumerate(codes) if code is None]
        ids, sizes = self._words([words[i] for i in fresh])
        raw = b"".join(x.tobytes() for x in ids)
        ends = (np.cumsum(np.concatenate(sizes)) * self.width).tolist() if sizes else []
        start = 0
        for i, end in zip(fresh, ends, strict=True):
            codes[i] = raw[start:end]
            start = end
        for i in fresh:
            if often[i] > 1 and len(self._known) < _KNOWN_WORDS:
                self._known[words[i]] = codes[i]
        lengths = np.fromiter(map(len, codes), np.int64, len(codes)) // self.width
        return [np.frombuffer(b"".join(codes), f"<u{self.width}")], [lengths]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Length of each text in ids, and all ids one after another."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, r"[\s\pZ\x{85}\x0b\x1c-\x1f] ")
        odd = pc.or_(odd, pc.match_substring_regex(texts, r" (?:[\s\pZ\x{85}\x0b\x1c-\x1f]|\z)"))
        for token in self._special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        odd = odd.to_numpy(zero_copy_only=False)
        n = len(texts)
        whole = np.flatnonzero(odd)
        plain = np.flatnonzero(~odd)
        parts = pc.split_pattern(texts.take(pa.array(plain)), " ")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(parts).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        heads = np.zeros(len(codes), dtype=bool)
        firsts = np.cumsum(counts) - counts
        heads[firsts] = True
        # Heads have no blank in front of them and get codes of their own.
        words = coded.dictionary
        used = np.zeros(len(words), dtype=bool)
        used[codes[~heads]] = True
        renumber = np.cumsum(used) - 1
        often = np.bincount(codes[~heads], minlength=len(words))[used]
        ids, sizes = self._recalled(words.filter(pa.array(used)).to_pylist(), often)
        head_codes, head_at = np.unique(codes[heads], return_inverse=True)
        singles = self._whole(words.take(pa.array(head_codes)).to_pylist())
        singles += self._whole(texts.take(pa.array(whole)).to_pylist())
        sizes = np.concatenate([*sizes, [len(x) for x in singles]]).astype(np.int64)
        flat = np.concatenate([*ids, *singles]) if len(sizes) else np.empty(0, f"<u{self.width}")
        codes = np.where(heads, 0, renumber[codes])
        codes[firsts] = int(used.sum()) + head_at

        order = np.empty(int(counts.sum()) + len(whole), dtype=np.int64)
        per_text = np.ones(n, dtype=np.int64)
        per_text[plain] = counts
        begins = np.cumsum(per_text) - per_text
        spread = np.repeat(begins[plain] - firsts, counts) + np.arange(len(codes))
        order[spread] = codes
        order[begins[whole]] = len(sizes) - len(whole) + np.arange(len(whole))

        from_ = np.cumsum(sizes) - sizes
        taken = sizes[order]
        ends = np.cumsum(taken)
        total = int(ends[-1]) if len(ends) else 0
        narrow = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
        gather = np.repeat((from_[order] - (ends - taken)).astype(narrow), taken)
        gather += np.arange(total, dtype=narrow)
        totals = np.zeros(len(order) + 1, dtype=np.int64)
        np.cumsum(taken, out=totals[1:])
        lengths = totals[begins + per_text] - totals[begins]
        return lengths, flat[gather]


_ENCODERS: dict[str, WordwiseEncoder] = {}


def encoder_of(path: str) -> WordwiseEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordwiseEncoder(path)
    return _ENCODERS[path]


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``_PASS_BYTES`` of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < len(sizes):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + _PASS_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


_WRITTEN = "path string, place long, doc_id long, file_start long, n_tokens long"


def _write_task(folder: str, vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = encoder_of(vocabulary)
        doc_ids, all_lengths, chunks = [], [], []
        for batch in batches:
            for piece in _slices(batch, "text"):
                lengths, ids = encoder(piece.column("text"))
                doc_ids.append(piece.column("doc_id"))
                ends = np.cumsum(lengths)
                chunks.append(np.insert(ids, ends, end_id).astype(f"<u{encoder.width}"))
                all_lengths.append(lengths + 1)
        if not doc_ids:
            return
        path = f"{folder}/part-{part:06d}.tok"
        lengths = np.concatenate(all_lengths)
        write_file(path, lengths, chunks, encoder.width)
        ids = pa.concat_arrays(doc_ids)
        starts = np.cumsum(lengths) - lengths
        for at in range(0, len(lengths), 10_000):
            n = min(10_000, len(lengths) - at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path] * n, pa.string()),
                    pa.array(np.arange(at, at + n)),
                    ids.slice(at, n),
                    pa.array(starts[at : at + n]),
                    pa.array(lengths[at : at + n]),
                ],
                names=["path", "place", "doc_id", "file_start", "n_tokens"],
            )

    return run


def write_token_files(
    docs: DataFrame,
    vocabulary: str,
    folder: str | None = None,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Encode every whole text and write the ids, in ascending id order, to files.

    Returns the stored table of documents: ``path, place, doc_id, file_start, start,
    n_tokens`` (``start`` counts the ids of all documents before it, in all files).
    ``end_id`` closes each document; a null text is like an empty one and holds only
    that. Null ids come first; equal ids follow each other by a hash of the text, and
    equal rows are written as often as they come. No rows in, no files.

    Rows are spread by id ranges, so one task writes one file of about 48 MB of text;
    it holds that file's ids. Files lie under ``folder``, by default in the folder that
    all executors share, and are moved into place when whole: a lost task is repeated
    under the same name.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    ).withColumn("_tie", F.xxhash64("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = task_count(spark, volume, _TASK_BYTES)
    # Equal rows fall into one range; a number below the tie lets ranges split them.
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    placed = rows.repartitionByRange(parts, "doc_id", "_tie", "_row").sortWithinPartitions(
        "doc_id", "_tie", "_row"
    )
    written = materialise(
        placed.select("doc_id", "text").mapInArrow(
            _write_task(folder, vocabulary, end_id), _WRITTEN
        ),
        "token-places",
    )
    # One row per file; names grow with the ranges of ids.
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    files = written.groupBy("path").agg(F.sum("n_tokens").alias("_ids"))
    offsets = materialise(
        files.select("path", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_before")),
        "file-offsets",
    )
    return written.join(offsets, "path").select(
        "path",
        "place",
        "doc_id",
        "file_start",
        (F.col("_before") + F.col("file_start")).alias("start"),
        "n_tokens",
    )


_DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_DIGEST_NAMES = ["doc_id", "start", "n_tokens", "ids_crc32"]


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            file = TokenFile(row["path"])
            docs = sorted(row["docs"], key=lambda doc: doc["place"])
            low, high = docs[0]["place"], docs[-1]["place"]
            ends = file.boundaries.range(low, high + 1)
            bounds = np.concatenate([[file.boundaries.end(low - 1)], ends])
            sums = [
                zlib.crc32(file.between(start, end).astype("<u4").tobytes())
                for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
            ]
            file.close()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([doc["doc_id"] for doc in docs], pa.int64()),
                    pa.array(bounds[:-1].astype(np.int64) + row["before"]),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array(sums, pa.int64()),
                ],
                names=_DIGEST_NAMES,
            )


def token_digests(places: DataFrame, slice_docs: int = 5_000) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, as the files have them.

    ``places`` is what ``write_token_files`` returned. Each file is read in slices of
    documents by separate tasks, the ids of one document at a time; lengths and places
    come out of the boundaries in the file.
    """
    slices = places.groupBy("path", F.floor(F.col("place") / slice_docs).alias("_slice")).agg(
        F.min(F.col("start") - F.col("file_start")).alias("before"),
        F.collect_list(F.struct("place", "doc_id")).alias("docs"),
    )
    n = task_count(places.sparkSession, 0, 1)
    return (
        slices.repartition(n, "path", "_slice")
        .select("path", "before", "docs")
        .mapInArrow(_read_task, _DIGESTS)
    )
