"""Quality rules: base figures of a text and an n-gram logistic regression against a fixed threshold.

The model is a logistic regression over hashed word and character n-grams,
trained on a bounded sample of labelled documents. A fifth of the sample is
kept from training; on it the score is turned into a probability (Platt's
sigmoid). Documents are scored in Arrow batches: each n-gram is one look-up.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.llm.bagminhash import Shingler
from corroborate.llm.common import IS_TOKEN_BYTE, SpanHash, add_columns, mix64, received, send, text_buffer, word_bounds
from corroborate.llm.ngrams import NGrams, labelled_sample, sigmoid

BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
_SYMBOL = np.array([chr(b) in "#*$%&|<>" for b in range(256)])


@dataclass(frozen=True)
class Thresholds:
    least_words: int = 50
    most_repeated: float = 0.5  # share of words in repeated three-word windows
    least_probability: float = 0.2


@dataclass
class Model:
    grams: NGrams = field(default_factory=NGrams)
    weights: np.ndarray | None = None  # None: there was nothing to learn from
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, texts: pa.Array, hasher: SpanHash) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), 0.5)
        return sigmoid(self.slope * (self.grams.means(texts, self.weights, hasher) + self.bias) + self.shift)


def fit(texts: list[str], labels: np.ndarray, grams: NGrams | None = None, epochs: int = 30, rate: float = 1.0) -> Model:
    """Train on four of five rows by full-batch AdaGrad, calibrate on the fifth.

    Without rows of both labels there is no verdict to learn: every
    probability is 0.5.
    """
    model = Model(grams or NGrams())
    held = np.arange(len(labels)) % 5 == 4
    if min((labels[~held] > 0).sum(), (labels[~held] == 0).sum()) == 0:
        return model
    rows = [r for i in range(0, len(texts), 200) for r in model.grams.rows(pa.array(texts[i : i + 200], pa.large_string()))]
    index = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    edges = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])))
    row = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(edges))
    del rows
    weights, squares, bias = np.zeros(model.grams.buckets, np.float32), np.full(model.grams.buckets, 1e-8), 0.0
    share = np.where(labels > 0, 0.5 / labels[~held].sum(), 0.5 / (1 - labels[~held]).sum()) * ~held

    def scores():
        return np.bincount(row, weights[index] * value, len(labels)) + bias

    for _ in range(epochs):
        slope = (sigmoid(scores()) - labels) * share
        gradient = np.bincount(index, slope[row] * value, model.grams.buckets) + 1e-7 * weights
        squares += gradient**2
        weights -= (rate * gradient / np.sqrt(squares)).astype(np.float32)
        bias -= 0.5 * float(slope.sum())
    model.weights, model.bias = weights, bias
    model.slope, model.shift = platt(scores()[held], labels[held])
    return model


def platt(scores: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of the sigmoid that fits held-out labels best (Newton's method, smoothed targets)."""
    positive, negative = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([scores, np.ones(len(scores))])
    for _ in range(steps if len(scores) else 0):
        p = sigmoid(theta @ x)
        gradient = x @ (p - target) + 1e-3 * (theta - [1.0, 0.0])
        hessian = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - np.clip(step, -1, 1)
    return max(0.05, float(theta[0])), float(theta[1])


class BaseFigures:
    """The figures of ``BASE`` for a string array; null has no words."""

    def __init__(self):
        self.hash = SpanHash()

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        data, offsets = text_buffer(texts)
        starts, ends, first = word_bounds(data, offsets, IS_TOKEN_BYTE)

        def per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[edges])

        return [
            np.diff(first),
            per_text(IS_TOKEN_BYTE[data] & ((data & 0xC0) != 0x80), offsets),
            per_text(_SYMBOL[data], offsets),
            self.dup_lines(data, offsets, starts),
            per_text(self.repeated(data, starts, ends, first), first),
        ]

    def dup_lines(self, data, offsets, starts) -> np.ndarray:
        breaks = np.flatnonzero(data == 0x0A)
        begin = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
        end = np.minimum(
            np.append(breaks, len(data))[np.searchsorted(breaks, begin)], offsets[np.searchsorted(offsets, begin, "right").clip(max=len(offsets) - 1)]
        )
        words = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
        begin, end = begin[words], end[words]
        text = np.searchsorted(offsets, begin, "right") - 1
        named = mix64(self.hash(data, begin, end) + mix64(text.astype(np.uint64)))
        _, kept = np.unique(named, return_index=True)
        extra = np.ones(len(begin), bool)
        extra[kept] = False
        return np.bincount(text[extra], minlength=len(offsets) - 1)

    def repeated(self, data, starts, ends, first) -> np.ndarray:
        """Which words stand in a three-word window that the text has twice or more."""
        covered = np.zeros(len(starts), bool)
        windows = Shingler.join(self.hash(data, starts, ends), 3)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        inside = np.flatnonzero(text[: len(windows)] == text[2:]) if len(windows) else np.zeros(0, np.int64)
        named = mix64(windows[inside] + mix64(text[inside].astype(np.uint64)))
        _, inverse, counts = np.unique(named, return_inverse=True, return_counts=True)
        again = inside[counts[inverse] > 1]
        for i in range(3):
            covered[again + i] = True
        return covered


def train(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """A model from labelled documents; ``options`` are those of ``labelled_sample``."""
    return fit(*labelled_sample(docs, labels, **options))


def judge(docs: DataFrame, model: Model, text: str = "text", thresholds: Thresholds = Thresholds()) -> DataFrame:
    """All rows of ``docs`` with the base figures, ``probability``, ``base_failed`` and ``kept``.

    A text fails the base rules if it has fewer than ``least_words`` words or
    if more than ``most_repeated`` of them stand in repeated windows; such
    texts, null and empty ones among them, are not kept. Of the others those
    are kept whose calibrated probability of the good label reaches the
    threshold. Columns of ``docs`` with one of these names are replaced.
    """
    sent = send(docs.sparkSession, model)

    def build():
        figures, hasher, scorer = BaseFigures(), SpanHash(), received(sent)

        def compute(texts: pa.Array) -> list[pa.Array]:
            made = [pa.array(x, pa.int64()) for x in figures(texts)]
            return [*made, pa.array(scorer.probability(texts, hasher), pa.float64())]

        return compute

    failed: Column = (F.col("n_words") < thresholds.least_words) | (
        F.col("n_repeat_words") > thresholds.most_repeated * F.col("n_words")
    )
    judged = add_columns(docs, text, f"{BASE}, probability double", build)
    return judged.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("probability") >= thresholds.least_probability)
    )
