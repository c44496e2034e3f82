"""Canonical text of a result cell, so that equal answers compare equal.

NULL equals the empty string, and 1, 1.0 and '1' equal each other; text is left
alone, so '1.0' stays different from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TWO_63 = "9.223372036854775808E18D"
_TWO_126 = "8.507059173023462E37D"  # whole doubles below this fit decimal(38, 0)


def _large_whole(v: str) -> str:
    """All digits of a whole double from 2**63 up, put together from two words."""
    high = f"floor(abs({v}) / {_TWO_63})"
    low = f"CAST(abs({v}) - CAST({high} AS DOUBLE) * {_TWO_63} AS BIGINT)"
    digits = (
        f"CAST(CAST({high} AS DECIMAL(19,0)) * CAST('9223372036854775808' AS DECIMAL(19,0))"
        f" + {low} AS STRING)"
    )
    return f"concat(CASE WHEN {v} < 0 THEN '-' ELSE '' END, {digits})"


def _small_fraction(v: str) -> str:
    """A fraction below 1e-4 with an exponent of at least two digits."""
    text = f"CAST({v} AS STRING)"
    mantissa = f"replace(concat(substring_index({text}, 'E-', 1), 'E'), '.0E', 'E')"
    exponent = f"substring_index({text}, 'E-', -1)"
    padded = f"lpad({exponent}, greatest(2, length({exponent})), '0')"
    return f"concat(rtrim('E', {mantissa}), 'e-', {padded})"


def _double_text(v: str) -> str:
    """Whole numbers without a point; else the shortest digits, plain from 1e-4 up."""
    plain = f"rtrim('0', CAST(CAST({v} AS DECIMAL(38,21)) AS STRING))"
    return (
        f"CASE WHEN isnan({v}) THEN 'nan'"
        f" WHEN abs({v}) >= {_TWO_126} THEN"
        f" replace(lower(CAST({v} AS STRING)), 'infinity', 'inf')"
        f" WHEN rint({v}) = {v} AND abs({v}) < {_TWO_63} THEN CAST(CAST({v} AS BIGINT) AS STRING)"
        f" WHEN rint({v}) = {v} THEN {_large_whole(v)}"
        f" WHEN abs({v}) >= 1e-3D AND abs({v}) < 1e7D THEN CAST({v} AS STRING)"
        f" WHEN abs({v}) >= 1e-4D THEN {plain}"
        f" ELSE {_small_fraction(v)} END"
    )


def canonical_cell(value: str, data_type: T.DataType, digits: int | None = None) -> Column:
    """Canonical text of one cell, given as SQL text, of the given type.

    ``digits`` rounds floating-point cells first; leave it out for the exact
    comparison. Use it where two plans may add doubles in different orders.
    """
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        number = f"CAST({value} AS DOUBLE)"
        text = _double_text(number if digits is None else f"round({number}, {digits})")
    elif isinstance(data_type, T.DecimalType):
        # Formatting, unlike a cast, never writes an exponent, whatever the ANSI setting.
        text = f"replace(format_number({value}, {data_type.scale}), ',', '')"
        if data_type.scale > 0:
            text = f"rtrim('.', rtrim('0', {text}))"
    elif isinstance(data_type, T.BooleanType):
        text = f"CAST(CAST({value} AS INT) AS STRING)"
    elif isinstance(data_type, T.BinaryType):
        text = f"hex({value})"
    elif isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        text = f"to_json({value})"
    else:
        text = f"CAST({value} AS STRING)"
    return F.expr(f"coalesce({text}, '')")


def quoted(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def canonical_row(df: DataFrame, digits: int | None = None) -> Column:
    """All cells of a row by position; column names play no part.

    A query that repeats a name needs fresh names first (``positional``).
    """
    return F.array(
        *[canonical_cell(quoted(f.name), f.dataType, digits) for f in df.schema.fields]
    )


def positional(df: DataFrame) -> DataFrame:
    """The same rows with columns named by position."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])
