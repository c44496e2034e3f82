"""Mixing sources to target weights by balanced sampling (cube method)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import in_sequence, number_rows
from ..session import materialise
from .common import MATCH_COLUMNS, match_columns, text_key, with_match

WORD = r"[^\x20\x09-\x0D]+"
# Units of one source that one task balances at a time.
CHUNK = 4096
_EDGE = 1e-9


def word_count(text: Column) -> Column:
    """Runs of characters that are not ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """``source, rank, source_size, target`` from ``source, size`` rows.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes. A target stops at ``most`` times its source's size; what
    that leaves over goes to the others by weight until none is above. Each round is one
    aggregate over the table of sources, and each but the last caps at least one more.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = number_rows(by_source, [F.col("source").isNull(), F.col("source")], name="rank")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    table = materialise(
        ranked.select(
            "source",
            "rank",
            "source_size",
            turn[(F.col("rank") % len(weights)).cast("int")].alias("_weight"),
            (F.col("source_size") * F.lit(float(most))).alias("_cap"),
        ),
        "sources",
    )
    free, level, capped = None, None, F.lit(False)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    while True:
        row = table.agg(
            F.coalesce(F.sum(F.when(capped, F.col("_cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~capped, F.col("_weight"))), F.lit(0.0)),
            F.count_if(capped),
        ).first()
        if row[2] == free:
            break
        free = row[2]
        level = max(0.0, total * share - row[0]) / row[1] if row[1] else 0.0
        capped = capped | (F.col("_weight") * F.lit(level) > F.col("_cap"))
    target = F.when(capped, F.col("_cap")).otherwise(F.col("_weight") * F.lit(level or 0.0))
    return table.select("source", "rank", "source_size", target.alias("target"))


def cube_flight(
    chance: np.ndarray, load: np.ndarray, random: np.random.Generator
) -> np.ndarray:
    """Move inclusion chances to 0 or 1 until at most two are left between.

    Three units at a time walk along the one direction that changes neither the sum of
    chances nor the load they carry, to whichever end of the walk the lot names; the lot
    is weighted so that each chance stays what it was on average.
    """
    chance = chance.copy()
    lots = random.random(len(chance))
    ready: list[int] = []
    for unit in np.flatnonzero((chance > _EDGE) & (chance < 1 - _EDGE)):
        ready.append(int(unit))
        if len(ready) < 3:
            continue
        a, b, c = ready
        step = (load[b] - load[c], load[c] - load[a], load[a] - load[b])
        if not any(step):
            step = (1.0, -1.0, 0.0)
        up = down = np.inf
        for i, s in zip(ready, step, strict=True):
            if s > 0:
                up, down = min(up, (1 - chance[i]) / s), min(down, chance[i] / s)
            elif s < 0:
                up, down = min(up, chance[i] / -s), min(down, (1 - chance[i]) / -s)
        move = up if lots[unit] * (up + down) < down else -down
        for i, s in zip(ready, step, strict=True):
            value = chance[i] + move * s
            chance[i] = 0.0 if value < _EDGE else 1.0 if value > 1 - _EDGE else value
        ready = [i for i in ready if 0.0 < chance[i] < 1.0]
    chance[chance <= _EDGE] = 0.0
    chance[chance >= 1 - _EDGE] = 1.0
    return chance


# Units kept out of the last flight, so that landing has something to choose from.
_LANDING = 12


def landing(chance: np.ndarray, load: np.ndarray) -> np.ndarray:
    """Settle a handful of units: of all 0/1 choices whose number of units is within one
    of what is due, the one whose load is nearest to what is due."""
    chance = chance.copy()
    rest = np.flatnonzero((chance > 0) & (chance < 1))
    if not len(rest):
        return chance
    choices = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1
    off_count = np.abs(choices.sum(axis=1) - chance[rest].sum())
    off_load = np.abs(choices @ load[rest] - (chance[rest] * load[rest]).sum())
    chance[rest] = choices[np.lexsort((off_count, off_load + (off_count > 1) * 1e18))[0]]
    return chance


def settle_all(
    chance: np.ndarray, load: np.ndarray, random: np.random.Generator
) -> np.ndarray:
    """Flight and landing of one source's last units."""
    opened = np.flatnonzero((chance > _EDGE) & (chance < 1 - _EDGE))
    by_load = opened[np.argsort(load[opened], kind="stable")]
    # Light and heavy ones alike, so that their sums lie close together.
    picks = np.unique(np.linspace(0, max(len(by_load) // 2, 1) - 1, _LANDING).astype(int))
    kept = by_load[picks] if len(by_load) else by_load
    flying = chance.copy()
    flying[kept] = 0.0
    flown = cube_flight(flying, load, random)
    flown[kept] = chance[kept]
    return landing(flown, load)


_UNITS = "_source long, _seq long, _unit long, size long, _chance double"


def _settle(seed: int, level: int, last: bool):
    def run(keys: tuple, units: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values(["_unit"], kind="stable").reset_index(drop=True)
        random = np.random.default_rng([seed, level, *(int(k) for k in keys)])
        load = units["size"].to_numpy(np.float64)
        move = settle_all if last else cube_flight
        units["_chance"] = move(units["_chance"].to_numpy(np.float64), load, random)
        return units[["_source", "_seq", "_unit", "size", "_chance"]]

    return run


def balanced_choice(units: DataFrame, seed: int = 7, chunk: int = CHUNK) -> DataFrame:
    """Settle ``_source, _seq, _unit, size, _chance`` so that every chance is 0 or 1.

    ``_seq`` names a unit and ``_unit`` is a number it always gets.

    Each source is dealt into chunks by a hash; a chunk is balanced in one task and
    leaves at most two units open. Those meet again in the next round, until one chunk
    per source is left, which is landed. No task ever gets more than about ``chunk``
    units, whatever share of the rows its source has.
    """
    opened = (F.col("_chance") > _EDGE) & (F.col("_chance") < 1 - _EDGE)
    settled = [units.where(~opened)]
    rest = materialise(units.where(opened), "units")
    level = 0
    while True:
        counts = materialise(rest.groupBy("_source").count(), "counts")
        most = counts.agg(F.max("count")).first()[0] or 0
        last = most <= chunk
        pieces = F.ceil(F.col("count") / chunk)
        place = F.pmod(F.xxhash64(F.lit(seed + level), "_unit"), pieces)
        moved = (
            rest.join(counts, "_source")
            .withColumn("_piece", place)
            .groupBy("_source", "_piece")
            .applyInPandas(_settle(seed, level, last), _UNITS)
        )
        moved = materialise(moved, "moved")
        settled.append(moved.where(~opened))
        if last:
            break
        rest, level = moved.where(opened), level + 1
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: int = 7,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """How often each document is taken so that every source meets its target.

    A document of a source with target t and size s is taken t/s times: the whole part
    for certain, the fraction as an inclusion chance that the cube method settles while
    it keeps, per source, the number of documents and the number of words in balance.
    What each source gets misses its target by no more than about one document's words.

    Returns ``doc_id, source, size, source_size, target, copies, taken``, one row per row
    given. A null or empty text weighs 0 and may be taken at no cost. A null source is a
    source of its own, last in order. Rows equal in id are separate documents; equal rows
    are told apart by a number given once. Reruns over the same rows agree: lots depend on
    the seed and on ids only (and, among rows equal in id, on their text). No rows in, no
    rows out.
    """
    sized = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(source_column).cast("string").alias("source"),
        word_count(F.col(text_column)).alias("size"),
        text_key(F.col(text_column)).alias("_text"),
    )
    sized = materialise(in_sequence(sized), "sizes")
    targets = materialise(source_targets(sized, weights, share, float(most)), "targets")
    twin = Window.partitionBy("doc_id", "_text", "source").orderBy("size")
    unit = F.xxhash64("doc_id", "_text", "source", F.row_number().over(twin))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    keyed = (
        sized.withColumn("_unit", unit)
        .alias("d")
        .join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select(
            "d.*",
            F.col("t.rank").alias("_source"),
            "t.source_size",
            "t.target",
            rate.alias("_rate"),
        )
    )
    # A rate within rounding of a whole number is that number.
    whole = F.floor(F.col("_rate") + _EDGE)
    keyed = materialise(
        keyed.withColumn("_whole", whole).withColumn(
            "_chance", F.greatest(F.col("_rate") - F.col("_whole"), F.lit(0.0))
        ),
        "keyed",
    )
    chosen = balanced_choice(keyed.select("_source", "_seq", "_unit", "size", "_chance"), seed)
    copies = (F.col("_whole") + F.round(F.col("c._chance"))).cast("int")
    return (
        keyed.alias("k")
        .join(chosen.select("_seq", "_chance").alias("c"), F.col("k._seq") == F.col("c._seq"))
        .select(
            "doc_id",
            F.col("_text").alias("_key"),
            "source",
            F.col("k.size").alias("size"),
            "source_size",
            "target",
            copies.alias("copies"),
            (F.col("k.size") * copies).cast("long").alias("taken"),
        )
    )


def mixed(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: int = 7,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; all columns stay.

    Rows equal in id, text and source share their copies evenly, the first ones getting
    one more where they do not divide.
    """
    found = mix_sources(
        docs, weights, share, most, seed, id_column, text_column, source_column
    )
    origin = F.xxhash64(F.col("source"), F.col("source").isNull()).alias("_origin")
    names = [*MATCH_COLUMNS, "_origin"]
    copies = (
        found.select(*match_columns("doc_id", F.col("_key")), origin, "copies")
        .groupBy(*names)
        .agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
        .where("_copies > 0")
    )
    source = F.col(f"_row.{source_column}").cast("string")
    rows = (
        with_match(docs, id_column, text_column)
        .withColumn("_origin", F.xxhash64(source, source.isNull()))
        .join(copies, names)
    )
    twin = F.row_number().over(Window.partitionBy(*names).orderBy("_key"))
    times = F.expr("_copies div _rows + int(_twin <= _copies % _rows)")
    repeated = rows.withColumn("_twin", twin).withColumn("_times", times)
    return repeated.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int")))).select(
        "_row.*"
    )
