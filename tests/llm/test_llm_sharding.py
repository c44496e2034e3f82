import zlib

import pytest

from llm_helpers import ODD, docs, frame, generator, prose
from sqlgauge.llm.sharding import shard_by_bytes


@pytest.mark.parametrize("n_shards", [1, 3, 8])
def test_shards_are_contiguous_and_even(spark, n_shards):
    rng = generator(n_shards)
    texts = [*ODD, *[prose(rng, rng.randrange(90)) for _ in range(400)]]
    found = sorted(shard_by_bytes(docs(spark, texts), n_shards).collect(), key=lambda r: r.doc_id)
    sizes = [len((t or "").encode()) + 1 for t in texts]
    assert [r["size"] for r in found] == sizes
    assert [r.text_crc32 for r in found] == [zlib.crc32((t or "").encode()) for t in texts]
    assert [r.shard for r in found] == sorted(r.shard for r in found)
    total, slots = [0] * n_shards, [0] * n_shards
    for r in found:
        assert r.slot == slots[r.shard]
        slots[r.shard] += 1
        total[r.shard] += r["size"]
    assert all(abs(t - sum(sizes) / n_shards) <= max(sizes) for t in total)


def test_ties_nulls_one_giant_and_nothing(spark):
    rows = [(None, None, "s"), (5, "b", "s"), (5, "a", "s"), (5, "a", "s"), (6, "x" * 1000, "s")]
    found = shard_by_bytes(frame(spark, rows), 4).collect()
    assert len(found) == 5
    for shard in {r.shard for r in found}:
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert [r.doc_id for r in found if r.shard == 0][0] is None
    assert shard_by_bytes(frame(spark, rows).where("false")).count() == 0
    with pytest.raises(ValueError):
        shard_by_bytes(frame(spark, rows), 0)
