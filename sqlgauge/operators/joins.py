"""Joining on keys that may be NULL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which NULL keys meet; the keys come from the left side.

    No side is broadcast by force: the planner does so when the size it knows or
    measures allows it, and adaptive execution splits skewed partitions otherwise.
    """
    a, b = left.alias("a"), right.alias("b")
    condition = reduce(and_, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    semi = how in ("left_semi", "left_anti")
    extra = [] if semi else [F.col(f"b.{c}") for c in right.columns if c not in keys]
    return a.join(b, condition, how).select("a.*", *extra)
