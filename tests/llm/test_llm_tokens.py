import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from llm_helpers import ODD, docs, frame, generator, prose
from sqlgauge.llm import token_files as T

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def encoded(text):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_agrees_with_the_library():
    rng = random.Random(3)
    letters = ["a", "b", " ", "  ", "\n", "\t", "é", "<|endoftext|>", "'s", "1", " ", "　", "!",
               "\r", "\x85", "\x1c", "漢", "😀", " ", "﻿"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(2500)]
    encoder = T.WordwiseEncoder(VOCABULARY)
    texts += ODD
    lengths, ids = encoder(pa.array(texts))
    ends = np.cumsum(lengths)
    for text, start, end in zip(texts, ends - lengths, ends, strict=True):
        want = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert ids[start:end].tolist() == want


@pytest.mark.parametrize("n, most", [(0, 1), (1, 1), (70, 2), (3000, 900), (500, 1 << 33)])
def test_boundaries(n, most):
    ends = np.cumsum(np.random.default_rng(n).integers(0, most, n))
    low, packed, high, directory = T.encode_boundaries(ends)
    coded = T.Boundaries(n, low, packed, high, directory)
    assert coded.range(0, len(ends)).tolist() == ends.tolist()
    for first in range(0, len(ends), 97):
        for size in (0, 1, 2, 63, 64, 500):
            last = min(first + size, len(ends))
            assert coded.range(first, last).tolist() == ends[first:last].tolist()
    assert [coded.end(i) for i in range(-1, n)] == [0, *ends.tolist()]
    if n >= 500:
        per = (len(packed) + len(high) + len(directory)) * 8 / n
        assert per <= 2 + np.log2(max(1, ends[-1] / n)) + 2


def test_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(T, "_TASK_BYTES", 2000)
    monkeypatch.setattr(T, "_PASS_BYTES", 700)
    rng = generator(2)
    texts = [*ODD, *[prose(rng, rng.randrange(80)) for _ in range(60)]]
    places = T.write_token_files(docs(spark, texts), VOCABULARY)
    got = {r.doc_id: r for r in T.token_digests(places, slice_docs=7).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = np.array([*encoded(text), 0], dtype="<u4")
        assert (got[i].start, got[i].n_tokens) == (start, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(ids.tobytes())
        start += len(ids)
    row = places.where("doc_id = 20").first()
    assert T.TokenFile(row.path).document(row.place).tolist() == [*encoded(texts[20]), 0]


def test_repeated_rows_null_ids_and_nothing(spark):
    rows = [(4, "b", "s"), (4, "a", "s"), (4, "a", "s"), (None, None, None)]
    got = T.token_digests(T.write_token_files(frame(spark, rows), VOCABULARY)).collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens) for r in got) == [
        ("4", 1, 2), ("4", 3, 2), ("4", 5, 2), ("None", 0, 1),
    ]
    empty = T.write_token_files(frame(spark, rows).where("false"), VOCABULARY)
    assert T.token_digests(empty).count() == 0


def test_damaged_files_are_refused(tmp_path):
    path = tmp_path / "x.tok"
    path.write_bytes(b"not a file" * 20)
    with pytest.raises(ValueError):
        T.TokenFile(str(path))
