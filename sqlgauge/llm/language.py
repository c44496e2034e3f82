"""Languages by family first, then by one-versus-one support vector machines."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .toxicity import held_out
from .words import BY_PUNCTUATION, column_bytes, segments, words

# Distinct texts per language, and languages, that take part in training at most.
FIT_DOCUMENTS = 400
FIT_LANGUAGES = 300
# Longer texts, in characters, are not drawn for training.
FIT_LENGTH = 50_000
UNKNOWN = "und"

# Letters: a-z in either case, and every byte of a character beyond ASCII.
LETTERS = BY_PUNCTUATION.copy()
LETTERS[48:58] = 0
BUCKET_BITS = 14
# Three bytes, four bytes, whole words.
TEMPLATES = 3
SIZE = TEMPLATES << BUCKET_BITS
_ODD = np.random.default_rng(77).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# Words of the stretches that train the machines on short texts.
_SHORT = (2, 5, 15)
_COST = 4.0
_EPOCHS = 12


def _buckets(code: np.ndarray, template: int) -> np.ndarray:
    high = (code * _ODD[7]) >> np.uint64(64 - BUCKET_BITS)
    return high.astype(np.int32) + np.int32(template << BUCKET_BITS)


def features(raw: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers of every place, and where each text's begin, per template.

    Grams are taken around every letter and end where its word does, so they neither
    depend on the texts beside theirs nor on where a long text is cut.
    """
    rows = len(bounds) - 1
    apart = np.repeat(np.arange(rows), np.diff(bounds))
    # A gap after every text, two before the first and behind the last.
    value = np.zeros(len(raw) + rows + 4, dtype=np.uint64)
    value[np.arange(len(raw)) + apart + 2] = LETTERS[raw]
    at = np.flatnonzero(value)
    of = np.searchsorted(at, bounds + np.arange(rows + 1) + 2)
    three = value[at - 1] * _ODD[0] + value[at] * _ODD[1] + value[at + 1] * _ODD[2]
    four = three + np.where(value[at + 1] != 0, value[at + 2], np.uint64(0)) * _ODD[3]
    _, hashes, word_of = words(raw, bounds, LETTERS)
    return [
        (_buckets(three, 0), of),
        (_buckets(four, 1), of),
        (_buckets(hashes, 2), word_of),
    ]


def _sums(found: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    """Per text the weights of its features added up, a row per text."""
    rows = len(found[0][1]) - 1
    total = np.zeros((rows, weights.shape[1]))
    for bucket, of in found:
        some = np.flatnonzero(np.diff(of) > 0)
        if len(some):
            for column in range(weights.shape[1]):
                each = weights[:, column][bucket]
                total[some, column] += np.add.reduceat(each, of[:-1][some], dtype=np.float64)
    return total


@dataclass
class Languages:
    """Families of languages and the machines that tell them apart."""

    names: list[str] = field(default_factory=list)
    families: list[list[int]] = field(default_factory=list)
    # One column per family: that family against the others.
    family: np.ndarray = field(default_factory=lambda: np.zeros((SIZE, 0), np.float32))
    # Of each family one column per two of its languages, the first against the second.
    pairs: list[np.ndarray] = field(default_factory=list)
    # What a usual gap is, between families and within each, per letter.
    gaps: list[float] = field(default_factory=list)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language of every text, and how sure that is."""
        rows = len(column)
        scores, letters = np.zeros((rows, len(self.families))), np.zeros(rows)
        for raw, bounds, of in segments(column, LETTERS):
            found = features(raw, bounds)
            scores[of] += _sums(found, self.family)
            letters[of] += np.diff(found[0][1])
        letters = np.maximum(letters, 1)
        chosen = scores.argmax(axis=1) if self.families else np.zeros(rows, int)
        sure = np.ones(rows)
        if len(self.families) > 1:
            best = np.sort(scores, axis=1)
            sure = _chance((best[:, -1] - best[:, -2]) / letters, self.gaps[0])
        out = np.zeros(rows, dtype=np.int64)
        for number, members in enumerate(self.families):
            mine = np.flatnonzero(chosen == number)
            out[mine] = members[0]
            if len(members) > 1 and len(mine):
                margin = np.zeros((len(mine), self.pairs[number].shape[1]))
                for raw, bounds, of in segments(column.take(pa.array(mine)), LETTERS):
                    margin[of] += _sums(features(raw, bounds), self.pairs[number])
                margin /= letters[mine, None]
                winner, least = _vote(margin, len(members))
                out[mine] = np.array(members)[winner]
                sure[mine] *= _chance(least, self.gaps[1 + number])
        return out, sure


def _chance(gap: np.ndarray, usual: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(3 * gap / max(usual, 1e-12), -30, 30)))


def _vote(margin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The language with the most duels won, sums deciding ties, and its closest duel."""
    votes, sums = np.zeros((len(margin), n)), np.zeros((len(margin), n))
    closest = np.full((len(margin), n), np.inf)
    for k, (a, b) in enumerate(combinations(range(n), 2)):
        won = margin[:, k] >= 0
        votes[:, a] += won
        votes[:, b] += ~won
        for side, value in ((a, margin[:, k]), (b, -margin[:, k])):
            sums[:, side] += value
            closest[:, side] = np.minimum(closest[:, side], value)
    tie = sums / (1 + np.abs(sums).max(axis=1, keepdims=True) * 2 * n)
    winner = (votes + tie).argmax(axis=1)
    return winner, closest[np.arange(len(margin)), winner]


# --- training ---------------------------------------------------------------------


class _Examples:
    """Sparse rows of length one."""

    def __init__(self, texts: pa.Array):
        self.at: list[np.ndarray] = []
        self.value: list[np.ndarray] = []
        for raw, bounds, _ in segments(texts, LETTERS):
            found = features(raw, bounds)
            for row in range(len(bounds) - 1):
                codes = np.concatenate([b[of[row] : of[row + 1]] for b, of in found])
                at, n = np.unique(codes, return_counts=True)
                self.at.append(at)
                self.value.append(n / np.sqrt(max(float((n * n).sum()), 1.0)))

    def machine(self, rows: np.ndarray, side: np.ndarray, seed: int) -> np.ndarray:
        """Weights of a linear support vector machine, by descent on the dual."""
        weights, alpha = np.zeros(SIZE), np.zeros(len(rows))
        slack = 1 / (2 * _COST)
        lots = np.random.default_rng(seed)
        for _ in range(_EPOCHS):
            moved = 0.0
            for k in lots.permutation(len(rows)).tolist():
                at, value, y = self.at[rows[k]], self.value[rows[k]], side[k]
                slope = y * float(weights[at] @ value) - 1 + alpha[k] * slack
                changed = max(alpha[k] - slope / (1 + slack), 0.0) - alpha[k]
                if changed:
                    alpha[k] += changed
                    weights[at] += changed * y * value
                    moved = max(moved, abs(changed))
            if moved < 1e-3:
                break
        return weights


def families_of(centres: np.ndarray) -> list[list[int]]:
    """Languages grouped by average similarity, about the root of their number of groups."""
    n = len(centres)
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1), 1e-12)[:, None]
    like = unit @ unit.T
    groups = [[k] for k in range(n)]
    while len(groups) > max(1, int(np.ceil(np.sqrt(n)))):
        a, b = max(
            combinations(range(len(groups)), 2),
            key=lambda pair: float(like[np.ix_(groups[pair[0]], groups[pair[1]])].mean()),
        )
        groups[a] = sorted(groups[a] + groups[b])
        del groups[b]
    return sorted(groups)


def fit_languages(texts: list[str], langs: list[str], seed: int = 11) -> Languages:
    """Families and machines from labelled texts, given in a fixed order.

    Every text takes part whole and as stretches of a few of its words, so that short
    texts are learnt as well.
    """
    names = sorted(set(langs))
    model = Languages(names, [[0]] if names else [], np.zeros((SIZE, len(names[:1])), np.float32))
    model.pairs, model.gaps = [np.zeros((SIZE, 0), np.float32)], [1.0, 1.0]
    if len(names) < 2:
        return model
    number = {name: k for k, name in enumerate(names)}
    y = np.array([number[lang] for lang in langs])
    lots = np.random.default_rng(seed)
    raw, bounds = column_bytes(pa.array(texts))
    starts, _, of = words(raw, bounds, LETTERS)
    cuts, cut_y = [], []
    for row in range(len(texts)):
        n = int(of[row + 1] - of[row])
        for size in _SHORT:
            if n > size:
                first = int(of[row]) + int(lots.integers(0, n - size))
                cuts.append(raw[starts[first] : starts[first + size]].tobytes())
                cut_y.append(y[row])
    whole = pa.array([t.encode() for t in texts], pa.large_binary())
    short = pa.array(cuts, pa.large_binary())
    examples = _Examples(pa.concat_arrays([whole, short]))
    label = np.concatenate([y, np.array(cut_y, dtype=np.int64)])
    centres = np.zeros((len(names), SIZE))
    for row in range(len(texts)):
        centres[y[row], examples.at[row]] += examples.value[row]
    model.families = families_of(centres)
    home = np.zeros(len(names), dtype=np.int64)
    for k, members in enumerate(model.families):
        home[members] = k
    everyone = np.arange(len(label))
    columns = []
    for k in range(len(model.families)):
        if len(model.families) == 2 and k == 1:
            columns.append(-columns[0])
        elif len(model.families) > 1:
            columns.append(examples.machine(everyone, np.where(home[label] == k, 1.0, -1.0), k))
        else:
            columns.append(np.zeros(SIZE))
    model.family = np.asfortranarray(np.stack(columns, axis=1), dtype=np.float32)
    model.pairs = []
    for members in model.families:
        duels = []
        for a, b in combinations(members, 2):
            rows = np.flatnonzero((label == a) | (label == b))
            duels.append(examples.machine(rows, np.where(label[rows] == a, 1.0, -1.0), a * 7919 + b))
        empty = np.zeros((SIZE, 0))
        stacked = np.stack(duels, axis=1) if duels else empty
        model.pairs.append(np.asfortranarray(stacked, dtype=np.float32))
    model.gaps = _usual_gaps(model, pa.array(texts))
    return model


def _usual_gaps(model: Languages, texts: pa.Array) -> list[float]:
    """Median gaps, per letter, between families and within each."""
    gaps: list[list[float]] = [[] for _ in range(1 + len(model.families))]
    for raw, bounds, _ in segments(texts, LETTERS):
        found = features(raw, bounds)
        letters = np.maximum(np.diff(found[0][1]), 1)
        scores = _sums(found, model.family) / letters[:, None]
        chosen = scores.argmax(axis=1)
        if scores.shape[1] > 1:
            best = np.sort(scores, axis=1)
            gaps[0] += (best[:, -1] - best[:, -2]).tolist()
        for k, members in enumerate(model.families):
            if len(members) > 1 and (chosen == k).any():
                margin = _sums(found, model.pairs[k])[chosen == k] / letters[chosen == k, None]
                gaps[1 + k] += _vote(margin, len(members))[1].tolist()
    return [max(float(np.median(g)), 1e-12) if g else 1.0 for g in gaps]


# --- operator ---------------------------------------------------------------------


def _lettered(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts: list[str] = []
    langs: list[str] = []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        langs += batch.column("lang").to_pylist()
    model = fit_languages(texts, langs)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], names=["model"])


def fit(
    docs: DataFrame,
    fit_documents: int = FIT_DOCUMENTS,
    fit_languages_: int = FIT_LANGUAGES,
    fit_length: int = FIT_LENGTH,
    id_column: str = "doc_id",
    lang_column: str = "lang",
    text_column: str = "text",
) -> Languages:
    """Learn from rows with a language that are not held out (runs jobs).

    Of the ``fit_languages_`` languages with the most distinct texts at most
    ``fit_documents`` distinct texts each are drawn by hash, none longer than
    ``fit_length`` characters; texts without a letter teach nothing. Copies count once,
    however many there are, so the drawn texts, which meet in one task, are bounded in
    number and size. Only the model reaches the driver.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(lang_column).cast("string").alias("lang"),
        F.col(text_column).alias("text"),
    )
    rows = rows.where(
        ~held_out(F.col("doc_id"))
        & F.col("lang").isNotNull()
        & (F.length("text") <= fit_length)
        & _lettered(F.col("text"))
    ).select("lang", F.xxhash64("text").alias("_key"), "text")
    keys = materialise(rows.select("lang", "_key").distinct(), "keys")
    by_size = keys.groupBy("lang").agg(F.count("*").alias("_n"))
    learnt = materialise(
        by_size.orderBy(F.desc("_n"), "lang").limit(fit_languages_).select("lang"), "languages"
    )
    over = Window.partitionBy("lang").orderBy(F.xxhash64("_key", F.lit(5)), "_key")
    drawn = materialise(
        keys.join(learnt, "lang")
        .withColumn("_rank", F.row_number().over(over))
        .where(F.col("_rank") <= fit_documents)
        .drop("_rank"),
        "drawn",
    )
    found = (
        rows.join(drawn, ["lang", "_key"])
        .groupBy("lang", "_key")
        .agg(F.min("text").alias("text"))
        .repartition(1)
        .sortWithinPartitions("lang", "_key")
        .mapInArrow(_fit_task, "model binary")
        .collect()
    )
    return pickle.loads(bytes(found[0]["model"])) if found else Languages()


_PREDICTED = "doc_id long, lang_pred string, score double"


def predict_languages(
    docs: DataFrame, model: Languages, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from the whole text alone.

    The family with the highest score is taken first; within it every two languages meet
    in a machine of their own and the one with the most duels won is predicted. ``score``
    says how clear both steps were, from 0 to 1. Null texts, texts without a letter, and
    all when no language was learnt, are ``und`` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the size the fit bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = shared.value
        names = np.array([*languages.names, UNKNOWN], dtype=object)
        for batch in batches:
            number, score = languages.predict(batch.column("text"))
            known = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            known &= len(languages.names) > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(names[np.where(known, number, len(names) - 1)], pa.string()),
                    pa.array(np.where(known, score, 0.0)),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    text = F.col(text_column)
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(text, F.lit("")).alias("text"),
        _lettered(text).alias("lettered"),
    ).mapInArrow(run, _PREDICTED)


def identify_languages(
    docs: DataFrame,
    fit_documents: int = FIT_DOCUMENTS,
    id_column: str = "doc_id",
    lang_column: str = "lang",
    text_column: str = "text",
) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and predict every row (runs jobs).

    Returns ``doc_id, held_out, lang_pred, score``, one row per row given. A null id is
    not held out; a null language teaches nothing. Rows given twice are answered twice,
    alike. No rows in, no rows out.
    """
    model = fit(
        docs,
        fit_documents,
        id_column=id_column,
        lang_column=lang_column,
        text_column=text_column,
    )
    return predict_languages(docs, model, id_column, text_column).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
