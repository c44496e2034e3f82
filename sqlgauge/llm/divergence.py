"""How the word use of each source departs from that of the others, in exact integers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

MIN_DOCUMENTS = 10
TOP = 10
UNIT = 1_000_000_000
# Cells (terms by groups) of one block, which one task multiplies.
BLOCK_CELLS = 1 << 18
# Indicator columns that are multiplied at once, two such tiles at a time.
TILE = 512
# Columns of one product and cells of its indicators, unless one term needs more by itself.
MOST_COLUMNS = 4096
_MOST_CELLS = 1 << 24
# Entries of a task's table of counts before it is handed on.
_ENTRIES = 400_000
# Bytes of text split at once; a longer text goes through in stretches.
_STRETCH = 4_000_000

# A-Z count as a-z; whatever else is ASCII separates, longer characters are letters.
_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_SEPARATOR = re.compile(rb"[^A-Za-z\x80-\xff]")


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a few megabytes of text at a time."""
    start = 0
    while start < len(text):
        stop = min(len(text), start + _STRETCH)
        if stop == len(text):
            yield text[start:].translate(_LOWER).split()
            return
        # Cut at the next separator.
        cut = _SEPARATOR.search(text, stop)
        stop = cut.start() if cut else len(text)
        yield text[start:stop].translate(_LOWER).split()
        start = stop


_COUNTED = "lang string, source string, term string, n long, docs long, whole long"


class _Counts:
    """Occurrences and documents of terms per group, handed on before they grow large."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.size = 0

    def add(self, group: tuple[str, str], found: list[bytes]) -> None:
        n, docs = self.groups.setdefault(group, (Counter(), Counter()))
        before = len(n)
        n.update(found)
        docs.update(set(found))
        self.size += len(n) - before

    def rows(self) -> pa.RecordBatch:
        """All counts, and the groups themselves, which may have no terms."""
        lang, source, term, times, held = [], [], [], [], []
        for (a, b), (n, docs) in self.groups.items():
            term += [None, *n]
            times += [0, *n.values()]
            held += [0, *(docs[t] for t in n)]
            lang += [a] * (len(n) + 1)
            source += [b] * (len(n) + 1)
        self.groups, self.size = {}, 0
        return _batch(lang, source, term, times, held, [None] * len(term))


def _batch(lang, source, term, n, docs, whole) -> pa.RecordBatch:
    columns = [
        pa.array(lang, pa.string()),
        pa.array(source, pa.string()),
        pa.array(term, pa.binary()).cast(pa.string()),
        pa.array(n, pa.int64()),
        pa.array(docs, pa.int64()),
        pa.array(whole, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(
        columns, names=["lang", "source", "term", "n", "docs", "whole"]
    )


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms counted within the task: ``n`` occurrences in ``docs`` documents.

    A text of several stretches does not keep all its terms at hand: its stretches come
    out with ``docs`` 0 and one number in ``whole``, and are told apart afterwards.
    """
    counts = _Counts()
    long_texts = TaskContext.get().partitionId() << 33
    for batch in batches:
        names = [batch.column(c).to_pylist() for c in ("lang", "source")]
        column = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(*names, column, strict=True):
            value = text.as_py()
            if len(value) <= _STRETCH:
                counts.add((lang, source), value.translate(_LOWER).split())
                if counts.size > _ENTRIES:
                    yield counts.rows()
                continue
            counts.add((lang, source), [])
            long_texts += 1
            for stretch in terms(value):
                tally = Counter(stretch)
                n = len(tally)
                yield _batch(
                    [lang] * n, [source] * n, list(tally), list(tally.values()),
                    [0] * n, [long_texts] * n,
                )
    yield counts.rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` over whole texts, and a row with a null term for
    every group (runs jobs).

    Terms are counted inside the tasks first, so a frequent one sends a row per task.
    """
    counted = materialise(docs.mapInArrow(_count_task, _COUNTED), "counted")
    group = ["lang", "source", "term"]
    once = (
        counted.where("whole IS NOT NULL")
        .groupBy(*group, "whole")
        .agg(F.sum("n").alias("n"))
        .select(*group, "n", F.lit(1).cast("long").alias("docs"))
    )
    rows = counted.where("whole IS NULL").select(*group, "n", "docs").unionByName(once)
    return materialise(
        rows.groupBy(*group).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms"
    )


def level_price(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(UNIT * (count + 2) / (total + 2 * kept))``, exact."""
    wide = (count + 2).cast("decimal(28,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return (F.call_function("div", wide, (total + 2 * kept).cast("decimal(38,0)")) + 1).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def departure(p: Column, q: Column) -> Column:
    """``floor((p - q)**2 / (p + q))``; prices stay below 2**31, so 64 bits are enough."""
    return _div((p - q) * (p - q), p + q)


# --- joint tables -----------------------------------------------------------------


def joint_values(
    term: np.ndarray, group: np.ndarray, price: np.ndarray, n_terms: int, zero: np.ndarray
) -> np.ndarray:
    """Summed departures of every two groups over ``n_terms`` terms.

    ``term, group, price`` are the entries above level zero; ``zero`` is each group's
    price of level zero. Every term is at one level in every group. With one indicator
    column per group and level, the product of the transpose with the columns counts the
    terms at each pair of levels: the joint tables of all pairs of groups at once, from
    which the departures are priced. Sums of 0 and 1 are exact in single precision.
    """
    groups = len(zero)
    total = np.zeros((groups, groups), dtype=np.int64)
    # Terms of few occurrences share levels; taken together they need few columns.
    weight = np.bincount(term, price.astype(float), minlength=n_terms)
    order = np.argsort(weight, kind="stable")
    place = np.empty(n_terms, dtype=np.int64)
    place[order] = np.arange(n_terms)
    by_term = np.argsort(place[term], kind="stable")
    term, group, price = place[term][by_term], group[by_term], price[by_term]
    starts = np.searchsorted(term, np.arange(n_terms + 1))
    at = 0
    while at < n_terms:
        stop = _fitting(at, n_terms, starts, group, price, groups)
        part = slice(starts[at], starts[stop])
        total += _product(term[part] - at, group[part], price[part], stop - at, zero)
        at = stop
    return total


def _columns(group: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, price) pairs as codes, and the code of every entry."""
    return np.unique(group.astype(np.int64) << 32 | price, return_inverse=True)


def _fitting(
    at: int, n_terms: int, starts: np.ndarray, group: np.ndarray, price: np.ndarray, groups: int
) -> int:
    """Where a run of terms from ``at`` ends whose levels need at most MOST_COLUMNS."""
    size, best = 1, at + 1
    while best < n_terms:
        stop = min(n_terms, at + size)
        part = slice(starts[at], starts[stop])
        columns = len(_columns(group[part], price[part])[0]) + groups
        if columns > MOST_COLUMNS or columns * (stop - at) > _MOST_CELLS:
            break
        best, size = max(best, stop), size * 2
    return best


def _product(
    term: np.ndarray, group: np.ndarray, price: np.ndarray, n_terms: int, zero: np.ndarray
) -> np.ndarray:
    codes, column = _columns(group, price)
    groups = len(zero)
    # Level zero of every group comes first: a 1 for each term without an entry there.
    names = np.concatenate([np.arange(groups), codes >> 32])
    prices = np.concatenate([zero, codes & 0xFFFFFFFF])
    order = np.argsort(names, kind="stable")
    names, prices = names[order], prices[order]
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    hot = np.zeros((n_terms, len(names)), dtype=np.float32)
    hot[:, place[:groups]] = 1
    hot[term, place[group]] = 0
    hot[term, place[groups + column]] = 1
    total = np.zeros((groups, groups), dtype=np.int64)
    for a in range(0, len(names), TILE):
        left = slice(a, a + TILE)
        for b in range(a, len(names), TILE):
            right = slice(b, b + TILE)
            joint = hot[:, left].T @ hot[:, right]
            i, j = np.nonzero(joint)
            p, q = prices[left][i], prices[right][j]
            value = joint[i, j].astype(np.int64) * ((p - q) * (p - q) // (p + q))
            pair = names[left][i] * groups + names[right][j]
            table = _sum_by(pair, value, groups * groups).reshape(groups, groups)
            total += table
            if a != b:
                total += table.T
    return total


def _sum_by(key: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of 64-bit integers per key."""
    out = np.zeros(size, dtype=np.int64)
    np.add.at(out, key, value)
    return out


_PAIR = "lang string, source string, other string, value long"


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    """All pairs of a language's groups, over one block of its terms."""
    rows = rows.sort_values(["source", "term"], kind="stable", na_position="first")
    zeros = rows["term"].isna().to_numpy()
    names = rows["source"].to_numpy()[zeros]
    zero = rows["price"].to_numpy()[zeros].astype(np.int64)
    entries = rows[~zeros]
    number = {name: at for at, name in enumerate(names)}
    group = np.fromiter((number[s] for s in entries["source"]), np.int64, len(entries))
    term, distinct = pd.factorize(entries["term"])
    total = joint_values(
        term, group, entries["price"].to_numpy().astype(np.int64), len(distinct), zero
    )
    i, j = np.triu_indices(len(names), 1)
    return pd.DataFrame(
        {
            "lang": np.full(len(i), rows["lang"].iloc[0], dtype=object),
            "source": names[i],
            "other": names[j],
            "value": total[i, j],
        }
    )


# --- operator ---------------------------------------------------------------------


def _named(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    empty = F.lit("")
    return docs.select(
        F.coalesce(F.col(lang).cast("string"), empty).alias("lang"),
        F.coalesce(F.col(source).cast("string"), empty).alias("source"),
        F.coalesce(F.col(text), empty).alias("text"),
    )


def source_divergence(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    top: int = TOP,
    lang_column: str = "lang",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """How far the term shares of each (lang, source) group lie from others (runs jobs).

    Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased. A
    language keeps its V terms that occur in ``min_documents`` or more of its documents;
    N is a group's number of kept occurrences. A term that occurs ``count`` times there is
    priced p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)); two prices depart from each
    other by floor((p - q)**2 / (p + q)). Everything is integer arithmetic.

    Returns ``lang, source, part, item, value, rank``. Part ``pair``: for every other
    source of the language the departures of all kept terms added up. Part ``term``: the
    ``top`` terms that the group uses more than its language as a whole, with their
    departures. Ranks start at 1, by falling value, then by item in UTF-8.

    Terms are counted inside the tasks before they are shuffled. The kept terms of a
    language are cut into blocks by hash; a task takes one block of one language, with
    all its groups at hand, and returns one number for each two groups. So neither a
    frequent term nor a large language meets in one task.

    Null language, source and text are empty; rows given twice count twice. A group
    without terms has its pairs (of value 0 where the language keeps no term) and no
    ``term`` rows. A language of one source has no pairs. No rows in, no rows out.
    """
    counted = term_counts(_named(docs, lang_column, source_column, text_column))
    real = counted.where("term IS NOT NULL")
    kept = materialise(
        real.groupBy("lang", "term")
        .agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= min_documents)
        .select("lang", "term", "total"),
        "kept",
    )
    entries = materialise(
        real.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "entries"
    )
    languages = kept.groupBy("lang").agg(
        F.count("*").alias("v"), F.sum("total").alias("lang_total")
    )
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    found = counted.where("term IS NULL").select("lang", "source")
    none = F.lit(0).cast("long")
    groups = materialise(
        found.join(sums, ["lang", "source"], "left")
        .join(languages, "lang", "left")
        .select(
            "lang",
            "source",
            *[F.coalesce(c, none).alias(c) for c in ("group_total", "v", "lang_total")],
        ),
        "groups",
    )
    priced = materialise(
        entries.join(groups, ["lang", "source"]).select(
            "lang",
            "source",
            "term",
            level_price(F.col("n"), F.col("group_total"), F.col("v")).alias("price"),
            level_price(F.col("total"), F.col("lang_total"), F.col("v")).alias("usual"),
        ),
        "priced",
    )
    over = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = (
        priced.where("price > usual")
        .select(
            "lang",
            "source",
            F.lit("term").alias("part"),
            F.col("term").alias("item"),
            departure(F.col("price"), F.col("usual")).alias("value"),
        )
        .withColumn("rank", F.row_number().over(over))
        .where(F.col("rank") <= top)
    )
    pairs = materialise(_pair_values(priced, groups), "pairs")
    mirrored = pairs.unionByName(
        pairs.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")
    )
    by_pair = mirrored.select(
        "lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value"
    ).withColumn("rank", F.row_number().over(over))
    return by_term.unionByName(by_pair).select("lang", "source", "part", "item", "value", "rank")


def _pair_values(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, other, value`` for every two sources of a language, once each."""
    sizes = groups.groupBy("lang").agg(F.count("*").alias("_g"), F.max("v").alias("_v"))
    blocks = materialise(
        sizes.where("_g > 1").select(
            "lang", F.floor(F.col("_g") * F.col("_v") / BLOCK_CELLS + 1).cast("long").alias("_blocks")
        ),
        "blocks",
    )
    entries = priced.join(blocks, "lang").select(
        "lang",
        F.pmod(F.xxhash64("term"), F.col("_blocks")).alias("block"),
        "source",
        "term",
        "price",
    )
    # The price of level zero of every group, beside every block of its language.
    zero = level_price(F.lit(0).cast("long"), F.col("group_total"), F.greatest("v", F.lit(1)))
    zeros = groups.join(blocks, "lang").select(
        "lang",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("block"),
        "source",
        F.lit(None).cast("string").alias("term"),
        zero.alias("price"),
    )
    return (
        entries.unionByName(zeros)
        .groupBy("lang", "block")
        .applyInPandas(_block, _PAIR)
        .groupBy("lang", "source", "other")
        .agg(F.sum("value").alias("value"))
    )
