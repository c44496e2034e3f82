"""Token sequences for training, calibration and batched generation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prompts import ChatTemplate, append_answer

# Fixed value: the label that a loss function skips.
IGNORED = -100

Tokenize = Callable[[str], list[int]]


def token_udf(make_tokenizer: Callable[[], Tokenize]) -> Callable[..., Column]:
    """A column function giving the token ids of a text, or of several texts at once.

    With one text the result is an array of ids, with more an array of such arrays,
    all from a single trip through Python. ``make_tokenizer`` is called once per
    task, so that a tokenizer is loaded where it is used; it returns a function from
    a text to its ids.
    """

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def token_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenize = make_tokenizer()
        for rows in batches:
            yield rows.map(
                lambda texts: [None if text is None else list(tokenize(text)) for text in texts]
            )

    def apply(*texts: Column) -> Column:
        ids = token_ids(F.array(*texts))
        return ids if len(texts) > 1 else F.get(ids, F.lit(0))

    return apply


def truncate(ids: Column, max_len: int) -> Column:
    return F.slice(ids, 1, max_len)


def mask_prompt(ids: Column, prompt_length: Column) -> Column:
    """Labels: ignored for the positions of the prompt, the ids after them."""
    return F.transform(ids, lambda x, i: F.when(i < prompt_length, F.lit(IGNORED)).otherwise(x))


def encode_examples(
    examples: DataFrame,
    tokenize: Callable[..., Column],
    template: ChatTemplate,
    max_len: int,
    keep: Sequence[str] = ("id",),
) -> DataFrame:
    """``input_ids`` and ``labels`` of examples with ``messages`` and ``gold_sql``.

    Only the answer is supervised: a prompt of ``max_len`` tokens or more leaves
    nothing. Other columns than ``keep`` are dropped. Number the batches before
    encoding rather than after: sorting reads its input twice.
    """
    texts = examples.select(
        *keep,
        template.render(F.col("messages"), True).alias("_prompt"),
        template.render(append_answer(F.col("messages"), F.col("gold_sql")), False).alias("_full"),
    )
    ids = texts.select(*keep, tokenize(F.col("_prompt"), F.col("_full")).alias("_ids"))
    cut = ids.withColumn("input_ids", truncate(F.get("_ids", F.lit(1)), max_len))
    prompt_length = F.size(F.get("_ids", F.lit(0)))
    return cut.select(
        *keep, "input_ids", mask_prompt(F.col("input_ids"), prompt_length).alias("labels")
    )


def _padding(value: int, missing: Column) -> Column:
    return F.array_repeat(F.lit(value), missing)


def pad_batches(
    rows: DataFrame, pad_id: int, batch: str = "batch_id", side: str = "right"
) -> DataFrame:
    """Pad every row to the longest ``input_ids`` of its batch.

    Adds ``attention_mask`` and pads ``labels``, if present, with the ignored label.
    Batches have a fixed small size, so each fits one task.
    """
    width = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    sized = rows.withColumn("_missing", width - F.size("input_ids"))

    def padded(values: Column, value: int) -> Column:
        filler = _padding(value, F.col("_missing"))
        return F.concat(values, filler) if side == "right" else F.concat(filler, values)

    mask = F.transform(F.col("input_ids"), lambda x: F.lit(1))
    changed = {
        "attention_mask": padded(mask, 0),
        "input_ids": padded(F.col("input_ids"), pad_id),
    }
    if "labels" in rows.columns:
        changed["labels"] = padded(F.col("labels"), IGNORED)
    return sized.withColumns(changed).drop("_missing")


def prompt_batches(
    prompts: DataFrame, pad_id: int, max_len: int = 2048, batch: str = "batch_id"
) -> DataFrame:
    """Truncated, left-padded ``input_ids`` for batched generation."""
    cut = prompts.withColumn("input_ids", truncate(F.col("input_ids"), max_len))
    return pad_batches(cut, pad_id, batch, side="left")


def strip_prompt(generated: Column, prompt_width: Column) -> Column:
    """The generated ids behind a padded prompt of the given width."""
    return F.slice(generated, prompt_width + 1, F.size(generated))


def calibration_ids(
    texts: DataFrame, tokenize: Callable[..., Column], max_len: int = 2048
) -> DataFrame:
    """Truncated token ids and mask of calibration texts."""
    ids = texts.withColumn("input_ids", truncate(tokenize(F.col("text")), max_len))
    mask = F.transform(F.col("input_ids"), lambda x: F.lit(1))
    return ids.withColumn("attention_mask", mask).drop("text")
