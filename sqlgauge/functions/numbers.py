"""Rounding and order-preserving buckets for doubles.

These take SQL text for the value, best a column name: the formulas repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: str, digits: int) -> Column:
    """Round a double as Python's ``round`` does: to nearest on the exact binary
    value, ties to even.

    ``round`` and ``bround`` work on the printed decimal, so 0.35 counts as a tie
    there although the stored number lies below it. Here the rounding error of
    ``value * 10**digits`` is recovered exactly and decides such cases; cutting the
    value into two 26-bit halves (the factor 2**27 + 1) makes that possible.
    """
    x, scale = f"CAST({value} AS DOUBLE)", f"{10**digits}D"
    product = f"({x} * {scale})"
    high = f"({x} * 134217729D - ({x} * 134217729D - {x}))"
    error = f"(({high} * {scale} - {product}) + ({x} - {high}) * {scale})"
    return F.expr(
        f"CASE WHEN abs({product} - rint({product})) <> 0.5D OR {error} = 0 THEN rint({product})"
        f" WHEN {error} > 0 THEN {product} + 0.5D"
        f" WHEN {error} < 0 THEN {product} - 0.5D"
        f" ELSE rint({product}) END / {scale}"
    )


def log_bucket(value: str, per_e_fold: int) -> Column:
    """A bucket number that never decreases as the value grows.

    Buckets have a constant relative width of ``1 / per_e_fold`` above 0.001 and a
    constant absolute width below; negative values mirror positive ones. Equal
    values share a bucket, so a bucket can be refined by the value itself. Infinities
    have buckets of their own, and NaN comes after everything else.
    """
    # The product overflows for the largest doubles, which then share the last bucket.
    magnitude = f"floor(least(log1p(abs({value}) * 1000D), 709D) * {per_e_fold}D)"
    last = 2**63 - 1
    return F.expr(
        f"CASE WHEN isnan({value}) THEN {last}L"
        f" WHEN {value} = CAST('inf' AS DOUBLE) THEN {last - 1}L"
        f" WHEN {value} = CAST('-inf' AS DOUBLE) THEN -{last - 1}L"
        f" WHEN {value} < 0 THEN -{magnitude} ELSE {magnitude} END"
    )


def rate(amount: str, seconds: str) -> Column:
    """``amount / seconds``, NULL when no time passed."""
    return F.expr(f"try_divide(CAST({amount} AS DOUBLE), CAST({seconds} AS DOUBLE))")
