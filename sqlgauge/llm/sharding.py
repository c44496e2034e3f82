"""Contiguous shards of nearly equal size in bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import in_sequence
from ..session import materialise
from .common import texts


def shard_by_bytes(
    docs: DataFrame, n_shards: int = 8, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Cut the documents, in id order, into ``n_shards`` runs of nearly equal bytes.

    A document weighs its UTF-8 bytes plus 1 for the separator. The narrow rows are
    sorted across the cluster and stored with the partition each fell into; totals per
    partition, one small row each, give every partition the bytes and rows before it,
    and a running sum inside the partition does the rest. A document belongs to the
    shard in which its middle byte lies, so a shard misses its target by less than one
    document on either side.

    Returns ``doc_id, size, text_crc32, shard, slot``; ``slot`` counts the documents of
    a shard from 0. A null text weighs 1 like an empty one. Null ids come first; equal
    ids follow each other by checksum and size, and equal rows each get their own slot.
    A shard may be empty when one document is larger than the target. No rows in, no
    rows out.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = F.coalesce("text", F.lit(""))
    sized = texts(docs, id_column, text_column).select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    ordered = sized.orderBy("doc_id", "text_crc32", "size", "_tie").drop("_tie")
    placed = materialise(in_sequence(ordered), "sized").withColumn(
        "_part", F.shiftright("_seq", 33)
    )

    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    parts = placed.groupBy("_part").agg(
        F.sum("size").alias("_bytes"), F.count("*").alias("_rows"), F.min("_seq").alias("_first")
    )
    # One row per partition of the sorted table.
    offsets = materialise(
        parts.select(
            "_part",
            F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
            (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_bytes").over(everything).alias("_total"),
        ),
        "offsets",
    )
    within = (
        Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = placed.withColumn("_inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    middle = "(2 * (_bytes_before + _inside) + size)"
    cut = materialise(
        summed.join(offsets, "_part").select(
            "doc_id",
            "size",
            "text_crc32",
            F.expr(f"cast(least({middle} * {n_shards} div (2 * _total), {n_shards - 1}) as int)")
            .alias("shard"),
            (F.col("_seq") + F.col("_shift")).alias("_row"),
        ),
        "shards",
    )
    firsts = cut.groupBy("shard").agg(F.min("_row").alias("_first"))
    return cut.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )
