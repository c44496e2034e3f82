"""The registry and SQL pieces shared by the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import ChatTemplate
from ..functions.text import WHITESPACE

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its checking SQL."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


# A plain way to write down a conversation, for the queries.
TEMPLATE = ChatTemplate(
    turn=lambda role, content: F.concat(F.lit("["), role, F.lit("] "), content),
    separator="\n",
    generation_prompt="\n[assistant]",
)


def sql_turns(*turns: tuple[str, str]) -> str:
    """The same in SQL: turns of a role and a text given as SQL."""
    return " || chr(10) || ".join(f"'[{role}] ' || {text}" for role, text in turns)


SQL_ASK = " || chr(10) || '[assistant]'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_strip(expression: str) -> str:
    return f"trim({expression}, {sql_text(WHITESPACE)})"


def sql_round(expression: str, digits: int) -> str:
    """Rounding to nearest on the exact binary value, ties to even, spelled out."""
    x = f"CAST({expression} AS DOUBLE)"
    scale = f"CAST({10**digits} AS DOUBLE)"
    high = f"({x} * 134217729.0::DOUBLE - ({x} * 134217729.0::DOUBLE - {x}))"
    error = f"(({high} * {scale} - {x} * {scale}) + ({x} - {high}) * {scale})"
    half = f"abs({x} * {scale} - floor({x} * {scale})) = 0.5"
    return (
        f"(CASE WHEN {half} AND {error} > 0 THEN floor({x} * {scale}) + 1 "
        f"WHEN {half} AND {error} < 0 THEN floor({x} * {scale}) "
        f"WHEN {half} THEN 2 * round(floor({x} * {scale}) / 2 + 0.25) "
        f"ELSE round({x} * {scale}) END / {scale})"
    )


def sql_percentile(percent: int, value: str = "v", row: str = "i", count: str = "n") -> str:
    """Interpolated percentile from rows numbered 0.. in value order."""
    rank = f"(CAST(max({count}) - 1 AS DOUBLE) * CAST({percent} / 100.0 AS DOUBLE))"
    at = f"(CAST({count} - 1 AS DOUBLE) * CAST({percent} / 100.0 AS DOUBLE))"
    low = f"max(CASE WHEN {row} = CAST(floor({at}) AS BIGINT) THEN {value} END)"
    high = f"max(CASE WHEN {row} = least(CAST(floor({at}) AS BIGINT) + 1, {count} - 1) THEN {value} END)"
    return f"({low} + ({high} - {low}) * ({rank} - floor({rank})))"
