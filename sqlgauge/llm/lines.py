"""Removal of repeated runs of lines by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import text_key, texts


def _hashes(lines: Column, salt: int) -> Column:
    return F.transform(lines, lambda line: F.xxhash64(F.lit(salt), line))


def fingerprints(keyed: DataFrame, min_lines: int, gram: int) -> DataFrame:
    """The selected positions of every document, once each, with what lies around them.

    Of the grams of ``gram`` lines in every window of ``min_lines`` lines the one with the
    smallest hash is selected, the rightmost of equal ones. Neighbouring windows mostly
    select the same one. ``fingerprint`` is its hash, ``start`` the first window that
    selects it, and ``reach`` has two hashes of each such window: the fingerprint extended
    to ``min_lines`` lines, from as far left as it goes to as far right.
    """
    width = min_lines - gram + 1
    hashed = (
        keyed.where(F.size("lines") >= min_lines)
        .select(
            "doc_id",
            "_key",
            _hashes(F.col("lines"), 1).alias("_a"),
            _hashes(F.col("lines"), 2).alias("_b"),
        )
        .dropDuplicates(["doc_id", "_key"])
    )

    def joined(column: str, start: Column, count: int) -> Column:
        return F.xxhash64(*[F.col(column)[start + F.lit(i)] for i in range(count)])

    def smallest(i: Column) -> Column:
        best, at = F.col("_g")[i], i
        for j in range(1, width):
            other = F.col("_g")[i + F.lit(j)]
            at = F.when(other <= best, i + F.lit(j)).otherwise(at)
            best = F.least(best, other)
        return at

    starts = F.sequence(F.lit(0), F.size("_a") - F.lit(gram))
    firsts = F.sequence(F.lit(0), F.size("_a") - F.lit(min_lines))
    selected = hashed.withColumn(
        "_g", F.transform(starts, lambda i: joined("_a", i, gram))
    ).withColumn("_at", F.transform(firsts, smallest))

    def place(i: Column) -> Column:
        at = F.col("_at")[i]
        before = F.when(i > 0, F.col("_at")[F.greatest(i - 1, F.lit(0))] == at)
        window = [
            F.when(
                F.coalesce(F.get("_at", i + F.lit(j)) == at, F.lit(False)),
                F.struct(
                    joined("_a", i + F.lit(j), min_lines).alias("a"),
                    joined("_b", i + F.lit(j), min_lines).alias("b"),
                ),
            )
            for j in range(width)
        ]
        found = F.struct(
            at.alias("pos"),
            i.alias("start"),
            F.col("_g")[at].alias("fingerprint"),
            F.array_compact(F.array(*window)).alias("reach"),
        )
        return F.when(~F.coalesce(before, F.lit(False)), found)

    return selected.select(
        "doc_id", "_key", F.inline(F.array_compact(F.transform(firsts, place)))
    )


def repeated_runs(keyed: DataFrame, min_lines: int, gram: int) -> DataFrame:
    """``doc_id, _key, runs``: the stretches of lines that occur earlier, per document."""
    marks = materialise(fingerprints(keyed, min_lines, gram), "fingerprints")
    shared = marks.groupBy("fingerprint").count().where("count > 1").select("fingerprint")
    # Positions that meet under a fingerprint, extended to both sides of it.
    extended = marks.join(shared, "fingerprint", "left_semi").select(
        "doc_id", "_key", "fingerprint", "start", F.posexplode("reach").alias("_far", "_window")
    )
    candidates = extended.select(
        "doc_id", "_key", "fingerprint", (F.col("start") + F.col("_far")).alias("pos"), "_window.*"
    )
    place = F.struct("doc_id", "_key", "pos")
    match = ["fingerprint", "a", "b"]
    firsts = (
        candidates.groupBy(*match)
        .agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .select(*match, "_first")
    )
    later = candidates.join(firsts, match).where(~place.eqNullSafe(F.col("_first")))
    # Neighbouring and overlapping windows grow into one run, to both sides.
    along = Window.partitionBy("doc_id", "_key").orderBy("pos")
    begins = F.coalesce(F.col("pos") > F.lag("pos").over(along) + min_lines, F.lit(True))
    runs = (
        later.select("doc_id", "_key", "pos", begins.cast("int").alias("_begins"))
        .withColumn("_run", F.sum("_begins").over(along))
        .groupBy("doc_id", "_key", "_run")
        .agg(F.min("pos").alias("start"), (F.max("pos") + min_lines).alias("end"))
    )
    return runs.groupBy("doc_id", "_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs")
    )


def drop_repeated_lines(
    docs: DataFrame,
    min_lines: int = 3,
    gram: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Delete every run of at least ``min_lines`` lines that occurs earlier in the corpus.

    Lines are what lies between line feeds, compared exactly. Earlier means a smaller
    (id, text hash, line number); the first occurrence stays. Line hashes are winnowed: in
    each window of ``min_lines`` lines the gram of ``gram`` lines with the smallest hash is
    selected, so any repeated run has a selected position in common with its copy. Only
    distinct selected positions are kept. They are joined on their fingerprint; those that
    meet another are extended to both sides, to every window of ``min_lines`` lines that
    selected them, by two 64-bit hashes over the lines. Windows that occur earlier grow
    together into runs. Groups are counted before they are shuffled and no pairs within a
    group are formed: each extension meets its first occurrence only.

    Returns ``doc_id, text, n_lines, n_removed`` with what is left of the text. A null
    text has no lines and stays null; an empty one is a single empty line. Rows equal in
    id and text count as one document and are answered alike. A document shorter than
    ``min_lines`` stays as it is. When a text repeats itself in overlapping windows, its
    first period stays. No rows in, no rows out.
    """
    if not 1 <= gram <= min_lines:
        raise ValueError("gram must lie between 1 and min_lines")
    keyed = texts(docs, id_column, text_column).select(
        "doc_id", "text", text_key(F.col("text")).alias("_key")
    )
    lines = F.split("text", "\n", -1)
    runs = repeated_runs(
        keyed.select("doc_id", "_key", lines.alias("lines")), min_lines, gram
    ).withColumnsRenamed({"doc_id": "_id", "_key": "_k"})
    hit = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k"))

    def stays(line: Column, i: Column) -> Column:
        return ~F.exists("runs", lambda run: (i >= run["start"]) & (i < run["end"]))

    left = F.when(F.col("runs").isNull(), lines).otherwise(F.filter(lines, stays))
    return keyed.join(runs, hit, "left").select(
        "doc_id",
        F.when(F.col("runs").isNull(), F.col("text"))
        .otherwise(F.array_join(left, "\n"))
        .alias("text"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0))
        .cast("long")
        .alias("n_lines"),
        F.coalesce(
            F.aggregate("runs", F.lit(0), lambda n, run: n + run["end"] - run["start"]), F.lit(0)
        )
        .cast("long")
        .alias("n_removed"),
    )
