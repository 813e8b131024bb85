"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

A document is the mean of the learned vectors of its hashed words, word pairs
and character n-grams; a linear layer and a softmax give the probabilities of
the labels. Since everything behind the vectors is linear up to the softmax,
scoring needs only each bucket's difference of logits: one look-up for each
n-gram.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corroborate.llm.common import SpanHash, add_columns, received, send
from corroborate.llm.ngrams import NGrams, labelled_sample, sigmoid


@dataclass
class Embeddings:
    grams: NGrams = field(default_factory=lambda: NGrams(bits=17, words=(1, 2), chars=(2, 3, 4)))
    vectors: np.ndarray | None = None  # buckets x dimensions; None: nothing to learn from
    output: np.ndarray | None = None  # labels x dimensions
    bias: np.ndarray | None = None

    def logits(self) -> tuple[np.ndarray, float]:
        """Difference of the two labels' logits for each bucket, and its constant."""
        difference = self.output[1] - self.output[0]
        return (self.vectors @ difference).astype(np.float32), float(self.bias[1] - self.bias[0])


def fit(
    texts: list[str], labels: np.ndarray, dimensions: int = 10, epochs: int = 12, rate: float = 0.2, seed: int = 7
) -> Embeddings:
    """Plain stochastic gradient descent, one document at a time, with a rate that falls to zero.

    Without rows of both labels nothing is learned and every score is 0.5.
    """
    model = Embeddings()
    if len(set(labels.tolist())) < 2:
        return model
    rng = np.random.default_rng(seed)
    rows = [r for i in range(0, len(texts), 200) for r in model.grams.rows(pa.array(texts[i : i + 200], pa.large_string()))]
    kinds = model.grams.kinds
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (model.grams.buckets, dimensions)).astype(np.float32)
    output, bias = np.zeros((2, dimensions), np.float32), np.zeros(2, np.float32)
    steps, at = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            index, value = rows[i]
            now = rate * (1 - at / steps)
            at += 1
            hidden = (value @ vectors[index]) / kinds
            logits = output @ hidden + bias
            p = np.exp(logits - logits.max())
            slope = p / p.sum()
            slope[int(labels[i])] -= 1
            back = slope @ output
            output -= now * np.outer(slope, hidden)
            bias -= now * 0.1 * slope
            # The rate of a bucket is not divided by the document's length, as in the usual implementations.
            vectors[index] -= (now * value * len(index)).clip(max=2.0 * now)[:, None] * back
    model.vectors, model.output, model.bias = vectors, output, bias
    return model


def train(docs: DataFrame, labels: DataFrame, **options) -> Embeddings:
    """A model from labelled documents; ``options`` are those of ``labelled_sample``."""
    return fit(*labelled_sample(docs, labels, **options))


def score(docs: DataFrame, model: Embeddings, text: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``score``, the probability of the good label.

    A null or empty text gets the score of the bias alone. A column of that
    name is replaced.
    """
    learned = model.vectors is not None
    table, constant = model.logits() if learned else (None, 0.0)
    kinds = model.grams.kinds
    sent = send(docs.sparkSession, (table, constant, model.grams, kinds))

    def build():
        hasher = SpanHash()
        weights, shift, grams, count = received(sent)

        def compute(texts: pa.Array) -> list[pa.Array]:
            if weights is None:
                return [pa.array(np.full(len(texts), 0.5))]
            return [pa.array(sigmoid(grams.means(texts, weights, hasher) / count + shift), pa.float64())]

        return compute

    return add_columns(docs, text, "score double", build)
