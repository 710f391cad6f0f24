"""Quality classification by Naive Bayes support vectors.

A text's features are indicators of hashed n-grams: its words and pairs of words, and
the shapes of its words and their pairs with the share of the text that they make up,
so that layout, symbols, capitals and repetition count as well as vocabulary. Each
indicator is scaled by the log ratio of its smoothed counts in the two classes, and a
linear model with hinge loss is fitted to the scaled, normalised indicators by dual
coordinate descent. Margins become scores by a logistic curve that is fitted to margins
of held-back halves.

The fit uses at most FIT_ROWS labelled rows, those of least hash of their id; only
their feature numbers come to the driver. Scoring reads every whole text, in place.

Defined cases: a null text counts as empty, and empty texts have a score like others;
labels other than 0 and 1, or of rows without a document, are left out; of several
labels of one id the largest counts; without labels of both classes every score is the
share of label 1, or 0.5 without any. Repeated rows get equal scores.
"""

from __future__ import annotations

import math
import zlib
from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, held, map_batches, text_rows, trimmed

#: Labelled rows that the fit uses at most, and hashed features.
FIT_ROWS, FEATURE_BITS = 6000, 18
#: Smoothing of the class counts, cost of a margin error, and passes of the descent.
SMOOTHING, COST, EPOCHS = 1.0, 1.0, 20
THRESHOLD = 0.7
#: Bytes of words kept with their hashes in each worker.
WORD_BYTES = 48 << 20
SHORT_WORD = 64

#: weights: a feature's ratio times its weight; squares: of the ratios; the rest turns a margin into a score.
Model = namedtuple("Model", "weights squares bias slope offset")

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def shape(word: str) -> str:
    """A word with letters and digits folded and runs of the same made one: 'Day,' -> 'Aa,'."""
    out = []
    for c in word:
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


class Words(Kept):
    """A word's hash in the upper half, its shape's in the lower."""

    def __init__(self):
        super().__init__(WORD_BYTES)

    def __missing__(self, word: str) -> int:
        raw = word.lower().encode("utf-8", "replace")
        code = zlib.crc32(raw) << 32 | zlib.crc32(shape(word).encode("utf-8", "replace"))
        return self.keep(word, code, len(word)) if len(word) <= SHORT_WORD else code


def _slots(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind)) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def _shares(h: np.ndarray, n: int, kind: int) -> np.ndarray:
    """Slots of values together with the share of n that each has, by halves."""
    values, counts = np.unique(h, return_counts=True)
    share = np.floor(np.log2(n / counts)).astype(np.uint64)
    return _slots(values * np.uint64(64) + share, kind)


def features(text: str) -> np.ndarray:
    """The distinct feature numbers of a text."""
    words = text.split()
    size = np.array([len(words).bit_length()], np.uint64)
    if not words:
        return _slots(size, 1)
    codes = np.fromiter(map(held("quality", Words).__getitem__, words), np.uint64, len(words))
    word, form = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
    found = [_slots(size, 1), _slots(word, 2), _shares(form, len(form), 3)]
    distinct = len(np.unique(word)) / len(word)
    found.append(_slots(np.array([int(distinct * 10)], np.uint64), 4))
    if len(word) > 1:
        found.append(_slots(word[:-1] * _C + word[1:], 5))
        found.append(_shares(form[:-1] * _C + form[1:], len(form) - 1, 6))
        again = int((word[1:] == word[:-1]).mean() * 20)
        found.append(_slots(np.array([again], np.uint64), 7))
    return np.unique(np.concatenate(found))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the linear model with hinge loss, the last one for a constant, by dual coordinate descent."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            if (step := (new - alpha[i]) * y[i]) != 0.0:
                w[rows[i]] += step * values[i]
                w[-1] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def ratios(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """The log ratio of every feature's smoothed share in class 1 to that in class 0."""
    of = lambda side: [r for r, k in zip(rows, y) if k == side]
    counts = [SMOOTHING + np.bincount(np.concatenate(of(side) or [np.empty(0, np.int32)]), minlength=size) for side in (1, -1)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def _train(rows, y, size):
    r = ratios(rows, y, size)
    values = [(r[x] / max(np.linalg.norm(r[x]), 1e-9)).astype(np.float32) for x in rows]
    return r, descend(rows, values, y, size)


def margin(x: np.ndarray, weights: np.ndarray, squares: np.ndarray, bias: float) -> float:
    return float(weights[x].sum() / max(math.sqrt(squares[x].sum()), 1e-9) + bias)


def _curve(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve for margins m (Platt's targets, damped Newton steps)."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, theta = np.stack([m, np.ones(len(m))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * theta)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit_rows(rows: list[np.ndarray], labels: list[int], bits: int = FEATURE_BITS) -> Model:
    """The model of rows of feature numbers and their labels."""
    size, y = 1 << bits, np.where(np.asarray(labels, int) == 1, 1, -1)
    if len(set(labels)) < 2:
        share = min(max(float(np.mean(labels)), 1e-6), 1 - 1e-6) if len(labels) else 0.5
        return Model(np.zeros(size, np.float32), np.ones(size, np.float32), 0.0, 0.0, math.log(share / (1 - share)))
    margins = np.zeros(len(rows))
    half = np.zeros(len(rows), bool)
    for side in (1, -1):  # halves of either class
        half[np.flatnonzero(y == side)[::2]] = True
    for part in (half, ~half):
        own, other = [rows[i] for i in np.flatnonzero(part)], np.flatnonzero(~part)
        if len(set(y[part])) < 2:
            own, part = rows, np.ones(len(rows), bool)
        r, w = _train(own, y[part], size)
        weights, squares, bias = w[:-1] * r, r * r, w[-1]
        margins[other] = [margin(rows[i], weights, squares, bias) for i in other]
        del r, w, weights, squares
    slope, offset = _curve(margins, y)
    r, w = _train(rows, y, size)
    return Model((w[:-1] * r).astype(np.float32), (r * r).astype(np.float32), float(w[-1]), slope, offset)


def held_out(doc_id):
    """Rows that no fit may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits to at most `rows` labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, so it may be broadcast

    def run(batches):
        for batch in batches:
            found = [features(t).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], names=["doc_id", "found", "label"])

    texts = text_rows(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    got = map_batches(texts, run, "doc_id bigint, found binary, label int").collect()
    by_id = {g["doc_id"]: g for g in got}  # a repeated row counts once
    got = [by_id[k] for k in sorted(by_id)]
    model = fit_rows([np.frombuffer(g["found"], np.int32) for g in got], [g["label"] for g in got])
    del got, by_id
    trimmed()
    return model


def score_text(text: str, model: Model) -> float:
    m = margin(features(text), model.weights, model.squares, model.bias)
    return 1 / (1 + math.exp(-min(max(model.slope * m + model.offset, -30.0), 30.0)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of whole texts; one row per row of `docs`, no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = [score_text(t, shipped.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return map_batches(text_rows(docs, id_col, text_col), run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose text scores at least `threshold`."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            good = [score_text(t or "", shipped.value) >= threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return map_batches(docs, run, docs.schema)
