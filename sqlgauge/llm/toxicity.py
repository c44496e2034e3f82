"""Toxic spans by a linear-chain conditional random field, and document scores."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import text_key, texts
from .words import BY_PUNCTUATION, column_bytes, pieces, prefixes, words

# A word is seen as itself and by its first bytes, so that endings never met in training
# do not hide a known stem.
PREFIXES = (3, 4, 5, 6, 7)
FORMS = 1 + len(PREFIXES)
# Buckets of each hashed feature: the forms of a word, the word before and the one after.
BUCKETS = 1 << 16
TEMPLATES = FORMS + 2
# Labelled documents that take part in training at most.
FIT_DOCUMENTS = 3000
# Characters of the longest text that takes part.
FIT_LENGTH = 30_000
# Tokens of one training stretch.
STRETCH = 96
_NONE = BUCKETS - 1
# Bytes of text scored together: the more texts, the fewer steps in all.
_SCORE_BYTES = 3_000_000


def word_forms(
    raw: np.ndarray, bounds: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start bytes of all words, their forms (32-bit hashes, one column each, 0 for none)
    and whose words they are."""
    starts, hashes, of = words(raw, bounds, BY_PUNCTUATION)
    stems = prefixes(raw, starts, PREFIXES, BY_PUNCTUATION)
    forms = np.concatenate([hashes[:, None], stems], axis=1) >> np.uint64(32)
    return starts, forms.astype(np.uint32), of


def features(forms: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Feature numbers of every token, one column per feature template."""
    found = np.empty((len(forms), TEMPLATES), dtype=np.int32)
    coded = (forms % np.uint32(BUCKETS - 1)).astype(np.int32)
    found[:, :FORMS] = np.where(forms != 0, coded, _NONE)
    before, after = found[:, FORMS], found[:, FORMS + 1]
    before[:], after[:] = _NONE, _NONE
    before[1:], after[:-1] = coded[:-1, 0], coded[1:, 0]
    heads, tails = of[:-1][of[:-1] < of[1:]], of[1:][of[:-1] < of[1:]] - 1
    before[heads], after[tails] = _NONE, _NONE
    return found + np.arange(TEMPLATES, dtype=np.int32) * np.int32(BUCKETS)


def _summed(weights: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Sum of each token's feature weights."""
    total = np.zeros(len(found))
    for column in found.T:
        total += weights[column]
    return total


@dataclass
class Field:
    """Weights of the field: label 1 against label 0 per feature, and between labels."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray  # log potentials, from label to label
    scale: np.ndarray  # of the document score: constant, highest marginal, sum

    def emission(self, found: np.ndarray) -> np.ndarray:
        return _summed(self.weights, found) + self.bias

    def odds(self, emission: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward messages at every token, as odds of label 1.

        All texts move together, one token a step, longest first, so a step costs one
        pass over the texts not yet ended.
        """
        lengths = np.diff(of)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = of[:-1][order], lengths[order]
        e = np.exp(np.clip(emission, -40, 40))
        t = np.exp(self.moves - self.moves[0, 0])
        forward, backward = np.empty_like(e), np.ones_like(e)
        most = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(1, most + 1), "right")
        state = np.empty(0)
        for step in range(most):
            at = starts[: active[step]] + step
            if step == 0:
                state = e[at].copy()
            else:
                state = state[: len(at)]
                state = e[at] * (t[0, 1] + t[1, 1] * state) / (1.0 + t[1, 0] * state)
            state = np.clip(state, 1e-30, 1e30)
            forward[at] = state
        state = np.ones(len(lengths))
        for step in range(most - 2, -1, -1):
            at = starts[: active[step + 1]] + step
            ahead = e[at + 1] * state[: len(at)]
            state[: len(at)] = (t[1, 0] + t[1, 1] * ahead) / (1.0 + t[0, 1] * ahead)
            backward[at] = state[: len(at)]
        return forward, backward

    def marginals(self, emission: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Chance of label 1 at every token."""
        forward, backward = self.odds(emission, of)
        both = np.clip(forward * backward, 1e-30, 1e30)
        return both / (1.0 + both)

    def summary(self, marginal: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Constant, highest marginal and damped sum of marginals per text."""
        out = np.zeros((len(of) - 1, 3))
        out[:, 0] = 1.0
        some = np.flatnonzero(np.diff(of) > 0)
        if len(some):
            heads = of[:-1][some]
            out[some, 1] = np.maximum.reduceat(marginal, heads)
            out[some, 2] = np.log1p(np.add.reduceat(marginal, heads))
        return out

    def score(self, summary: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(summary @ self.scale, -40, 40)))


def token_labels(
    forms: np.ndarray, of: np.ndarray, toxic: np.ndarray, least: int = 5, share: float = 0.5
) -> np.ndarray:
    """Label 1 for the words that make documents toxic, in toxic documents.

    A form counts when the share of toxic documents among those that hold it is above
    ``share`` beyond doubt (lower Wilson bound, 2.5 standard errors) and it was seen
    between at least ``least`` different pairs of neighbours there, so that copies of one
    text do not count as evidence. Of a word's forms the most specific one that is beyond
    doubt, on either side, decides.
    """
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    in_toxic = toxic[doc] > 0
    around = np.roll(forms[:, 0], 1) * np.uint32(31) + np.roll(forms[:, 0], -1)
    label = np.zeros(len(forms), dtype=bool)
    for form in [*forms.T[1:], forms.T[0]]:
        # Only forms of toxic documents can be evidence.
        known = np.unique(form[in_toxic])
        at = np.minimum(np.searchsorted(known, form), len(known) - 1)
        some = np.flatnonzero((known[at] == form) & (form != 0))
        at_some = at[some]
        pair = np.unique(at_some * len(of) + doc[some])
        held = np.bincount(pair // len(of), minlength=len(known)).astype(float)
        bad = np.bincount(pair // len(of), toxic[pair % len(of)], minlength=len(known))
        n, z2 = np.maximum(held, 1), 6.25
        p = bad / n
        width = np.sqrt(z2 * (p * (1 - p) / n + z2 / (4 * n**2)))
        low, high = ((p + z2 / (2 * n) + side * width) / (1 + z2 / n) for side in (-1, 1))
        mine = some[in_toxic[some]]
        order = np.lexsort((around[mine], at[mine]))
        a, b = at[mine][order], around[mine][order]
        fresh = np.ones(len(a), dtype=bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        seen = np.bincount(a[fresh], minlength=len(known))
        good = (low > share) & (seen >= least)
        label[some[good[at_some]]] = True
        label[some[(high < share)[at_some]]] = False
    return (label & in_toxic).astype(float)


def _stretches(of: np.ndarray) -> np.ndarray:
    """First and last-but-one token of every stretch."""
    counts = -(-np.diff(of) // STRETCH)
    first = np.repeat(of[:-1], counts)
    number = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = first + number * STRETCH
    return np.stack([starts, np.minimum(starts + STRETCH, np.repeat(of[1:], counts))])


def _climb(field: Field, found: np.ndarray, labels: np.ndarray, bounds: np.ndarray, rounds: int):
    """Set the weights by gradient ascent on the likelihood of the stretches' labels."""
    sizes = bounds[1] - bounds[0]
    cut = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(cut[-1]) + np.repeat(bounds[0] - cut[:-1], sizes)
    y = labels[at]
    inner = np.ones(len(at), dtype=bool)
    inner[cut[1:] - 1] = False
    here = np.flatnonzero(inner)
    used, compact = np.unique(found[at], return_inverse=True)
    compact = compact.reshape(len(at), TEMPLATES).astype(np.int32)
    weights, moves, bias = np.zeros(len(used)), np.zeros((2, 2)), -4.0
    m, v = (np.zeros(len(used) + 5) for _ in range(2))
    pairs_seen = np.bincount(
        (2 * y[here] + y[here + 1]).astype(np.int64), minlength=4
    ).reshape(2, 2)
    for turn in range(1, rounds + 1):
        field.bias, field.moves = bias, moves
        emission = _summed(weights, compact) + bias
        forward, backward = field.odds(emission, cut)
        both = np.clip(forward * backward, 1e-30, 1e30)
        gap = y - both / (1.0 + both)
        # Chances of each pair of neighbouring labels.
        t = np.exp(moves - moves[0, 0])
        left = forward[here]
        right = np.exp(np.clip(emission[here + 1], -40, 40)) * backward[here + 1]
        joint = np.stack(
            [np.ones_like(left), t[0, 1] * right, t[1, 0] * left, t[1, 1] * left * right]
        )
        joint /= joint.sum(axis=0)
        gradient = np.concatenate(
            [
                np.bincount(compact.ravel(), np.repeat(gap, TEMPLATES), len(used))
                - 0.02 * weights,
                [gap.sum()],
                (pairs_seen - joint.sum(axis=1).reshape(2, 2)).ravel() - 0.02 * moves.ravel(),
            ]
        )
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        step = 0.25 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)
        weights += step[: len(used)]
        bias += step[len(used)]
        moves = np.clip(moves + step[len(used) + 1 :].reshape(2, 2) * 0.2, -4, 4)
    field.weights = np.zeros(TEMPLATES * BUCKETS)
    field.weights[used], field.bias, field.moves = weights, float(bias), moves


def fit_field(
    forms: np.ndarray,
    of: np.ndarray,
    toxic: np.ndarray,
    rounds: int = 60,
    most_stretches: int = 5000,
    seed: int = 5,
) -> Field:
    """Fit the field to labelled tokens, then the document score.

    The first fit sees the stretches with toxic tokens and some others. Stretches in which
    it is then mistaken join them for the second fit, so that words which only look like
    toxic ones are learnt too. Without documents of both labels every score is the share
    of toxic ones.
    """
    base = float(np.clip(toxic.mean() if len(toxic) else 0.0, 1e-3, 1 - 1e-3))
    field = Field(
        np.zeros(TEMPLATES * BUCKETS),
        -4.0,
        np.zeros((2, 2)),
        np.array([np.log(base / (1 - base)), 0, 0]),
    )
    if not len(forms) or not 0 < toxic.sum() < len(toxic):
        return field
    found = features(forms, of)
    labels = token_labels(forms, of, toxic)
    bounds = _stretches(of)
    chosen = np.add.reduceat(labels, bounds[0]) > 0
    for _ in range(2):
        lots = np.random.default_rng(seed).random(bounds.shape[1])
        rank = np.lexsort((lots, ~chosen))[:most_stretches]
        _climb(field, found, labels, bounds[:, rank], rounds)
        marginal = field.marginals(field.emission(found), of)
        chosen |= np.maximum.reduceat(np.abs(marginal - labels), bounds[0]) > 0.1
    field.scale = _logistic(field.summary(marginal, of), toxic, base)
    field.weights = field.weights.astype(np.float32)
    return field


def _logistic(x: np.ndarray, y: np.ndarray, base: float) -> np.ndarray:
    """Logistic regression with a small penalty, by Newton steps."""
    w = np.zeros(x.shape[1])
    w[0] = np.log(base / (1 - base))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - 0.5 * w * [0, 1, 1]
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.diag([1e-6, 1, 1])
        w = w + np.clip(np.linalg.solve(bend, slope), -3, 3)
    return w


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forms, sizes, toxic = [np.empty((0, FORMS), np.uint32)], [], []
    for batch in batches:
        for piece in pieces(batch, "text"):
            _, found, of = word_forms(*column_bytes(piece.column("text")))
            forms.append(found)
            sizes.extend(np.diff(of).tolist())
            toxic.extend(piece.column("toxic").to_pylist())
    of = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    field = fit_field(np.concatenate(forms), of, np.array(toxic, dtype=float))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(field)])], names=["field"])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    fit_documents: int = FIT_DOCUMENTS,
    fit_length: int = FIT_LENGTH,
) -> Field:
    """Learn from at most ``fit_documents`` labelled texts of at most ``fit_length``
    characters, drawn by a hash of id and text.

    Only rows that are not held out take part, and rows equal in id and text count once.
    The draw is made on ids and hashes alone; then the drawn texts, bounded in number and
    in size, meet in one task, however many rows share an id. Only the weights, of fixed
    size, reach the driver.
    """
    rows = texts(docs).where(
        ~held_out(F.col("doc_id")) & (F.coalesce(F.length("text"), F.lit(0)) <= fit_length)
    )
    rows = rows.select("doc_id", text_key(F.col("text")).alias("_key"), "text")
    marked = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")
    ).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = (
        rows.select("doc_id", "_key")
        .distinct()
        .join(known, "doc_id")
        .orderBy(F.xxhash64("doc_id", "_key"), "doc_id", "_key")
        .limit(fit_documents)
    )
    found = (
        rows.join(materialise(drawn, "drawn"), ["doc_id", "_key"])
        .groupBy("doc_id", "_key", "toxic")
        .agg(F.min("text").alias("text"))
        .repartition(1)
        .sortWithinPartitions("doc_id", "_key")
        .mapInArrow(_fit_task, "field binary")
        .collect()
    )
    if not found:
        return fit_field(np.empty((0, FORMS), np.uint32), np.zeros(1, np.int64), np.empty(0))
    return pickle.loads(bytes(found[0]["field"]))


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())])
_SCORED = "doc_id long, score double, spans array<struct<start:int,end:int,chance:double>>"


def _spans(
    raw: np.ndarray, bounds: np.ndarray, starts: np.ndarray, of: np.ndarray, marginal: np.ndarray
) -> list[list[dict]]:
    """Code-point places of the tokens more likely toxic than not, joined when they touch."""
    out: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
    hits = np.flatnonzero(marginal >= 0.5)
    for token in hits.tolist():
        row = int(np.searchsorted(of, token, "right")) - 1
        begin = int(starts[token])
        text_start, text_end = int(bounds[row]), int(bounds[row + 1])
        length = 0
        while begin + length < text_end and BY_PUNCTUATION[raw[begin + length]]:
            length += 1
        points = (raw[text_start : begin + length] & 0xC0) != 0x80
        start = int(points[: begin - text_start].sum())
        out[row].append(
            {"start": start, "end": int(points.sum()), "chance": float(marginal[token])}
        )
    return out


def score_documents(
    docs: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, score, spans``: how likely a document is toxic, and where.

    Words are runs of letters and digits, A-Z lower-cased; every word of the whole text
    gets its marginal from the forward and backward recursions. The score combines the
    highest marginal and the sum of all, calibrated on the training documents. ``spans``
    are the words with a marginal of at least one half, in code points. A null text is an
    empty one; it scores what a text without any toxic word does. One row per row given.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # of fixed size: BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for piece in pieces(batch, "text", _SCORE_BYTES):
                raw, bounds = column_bytes(piece.column("text"))
                starts, forms, of = word_forms(raw, bounds)
                marginal = model.marginals(model.emission(features(forms, of)), of)
                score = model.score(model.summary(marginal, of))
                spans = _spans(raw, bounds, starts, of, marginal)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(score),
                        pa.array(spans, pa.list_(_SPAN)),
                    ],
                    names=["doc_id", "score", "spans"],
                )

    return texts(docs, id_column, text_column).mapInArrow(run, _SCORED)


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_documents: int = FIT_DOCUMENTS
) -> DataFrame:
    """Fit on ``labels`` and score every document (runs jobs).

    Returns ``doc_id, held_out, score, predicted, spans``. Labels with a null id or
    neither 0 nor 1 are ignored; of several labels of one id the highest counts. A null
    id is not held out. No rows in, no rows out.
    """
    field = fit(docs, labels, fit_documents)
    return score_documents(docs, field).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "spans",
    )


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    fit_documents: int = FIT_DOCUMENTS,
    text_column: str = "text",
) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay.

    The rows are scored where they lie, in one pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for piece in pieces(batch, text_column, _SCORE_BYTES):
                raw, bounds = column_bytes(piece.column(text_column))
                _, forms, of = word_forms(raw, bounds)
                marginal = model.marginals(model.emission(features(forms, of)), of)
                score = model.score(model.summary(marginal, of))
                yield piece.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
