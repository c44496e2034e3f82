"""Reproducible samples and head limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import ChatTemplate, messages_or_default
from ..session import materialise
from .joins import join_null_safe


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise ValueError when there are no rows (reads at most one)."""
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df


def head_limit(df: DataFrame, order_by: Sequence[str], limit: int | None) -> DataFrame:
    """The first ``limit`` rows in the given rising order; 0 or None means all of them.

    The order columns alone tell where to stop; whole rows are sorted only up to there.
    """
    if not limit:
        return df
    keys = F.struct(*[F.col(name) for name in order_by])
    last = df.select(*order_by).orderBy(*order_by).limit(limit).agg(F.max(keys)).scalar()
    return df.where(keys <= last).orderBy(*order_by).limit(limit)


def seeded_sample(df: DataFrame, id_column: str, n_samples: int = 256, seed: int = 42) -> DataFrame:
    """``n_samples`` rows without replacement, the same ones for the same seed.

    Rows are drawn by the smallest digest of seed and id, which does not depend on
    partitioning (runs jobs). Digests are evenly spread, so a bound on them leaves little
    more than the sample; only those ids are put in order, and only the drawn rows are
    fetched. Rows that share an id are drawn together or not at all, as far as they fit.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))
    ids = df.select(F.col(id_column).alias("_id"), digest.alias("_digest"))
    total = ids.count()
    share = 1.0
    if total > 4 * n_samples:
        share = 2.0 * (n_samples + 16) / total
    while True:
        bound = f"{min(int(share * 16**8), 16**8 - 1):08x}g"  # above all digests that start so
        below = ids if share >= 1.0 else ids.where(F.col("_digest") < bound)
        drawn = materialise(below.orderBy("_digest", "_id").limit(n_samples), "drawn")
        if share >= 1.0 or drawn.count() >= n_samples:
            break
        share *= 4
    chosen = drawn.select("_id").distinct()
    rows = join_null_safe(
        df.withColumn("_id", F.col(id_column)), chosen, ["_id"], "left_semi"
    )
    return rows.drop("_id").limit(n_samples)


def calibration_texts(
    examples: DataFrame,
    template: ChatTemplate,
    id_column: str = "id",
    n_samples: int = 256,
    seed: int = 42,
) -> DataFrame:
    """Sampled prompts as rendered text, ready for the model to answer.

    Examples hold ``messages`` or ``schema`` and ``question``. None at all is a
    ValueError.
    """
    chosen = seeded_sample(
        require_rows(examples, "examples"), id_column, n_samples, seed
    )
    messages = messages_or_default(F.col("messages"), F.col("schema"), F.col("question"))
    return chosen.select(id_column, template.render(messages, True).alias("text"))
