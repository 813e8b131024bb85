"""Hashed word and character n-grams of string arrays, and bounded samples of labelled texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.llm.common import IS_TOKEN_BYTE, LOWER_BYTES, SpanHash, mix64, text_buffer, thinned, word_bounds

_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


@dataclass(frozen=True)
class NGrams:
    """Which n-grams are made and how many buckets they are hashed to."""

    bits: int = 18
    words: tuple[int, ...] = (1, 2)
    chars: tuple[int, ...] = (3, 4)
    echoes: bool = True  # word pairs reduced to whether both are the same word

    @property
    def kinds(self) -> int:
        return len(self.words) + len(self.chars) + self.echoes

    @property
    def buckets(self) -> int:
        return 1 << self.bits

    def families(self, texts: pa.Array, hasher: SpanHash) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each kind of n-gram: the buckets of all of them, and the edges of each text's share.

        Words stand between ASCII white space; letters A-Z count as small ones.
        Character n-grams run over code points, white space included.
        """
        data, offsets = text_buffer(texts)
        data = LOWER_BYTES[data]
        starts, ends, first = word_bounds(data, offsets, IS_TOKEN_BYTE)
        words = hasher(data, starts, ends)
        for n in self.words:
            yield self._runs(words, first, n)
        if self.echoes:
            same = np.zeros(len(words), np.uint64)
            same[1:] = words[1:] == words[:-1]
            same[first[:-1][first[:-1] < len(words)]] = 0  # the first word of a text has none before it
            yield self._runs(same + np.uint64(1), first, 1)
        heads = (data & 0xC0) != 0x80
        at = np.concatenate(([0], np.cumsum(heads)))[offsets]
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        for n in self.chars:
            yield self._runs(points.astype(np.uint64), at, n)

    def _runs(self, units: np.ndarray, edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs of n units that stay inside one text."""
        count = max(0, len(units) - n + 1)
        total = np.full(count, n, np.uint64)
        for i in range(n):
            total = total + units[i : i + count] * _PRIMES[i]
        buckets = (mix64(total) >> np.uint64(64 - self.bits)).astype(np.int32)
        if n == 1:
            return buckets, edges
        inside = np.ones(count, bool)
        for i in range(1, n):
            crossing = edges[1:-1] - i
            inside[crossing[(crossing >= 0) & (crossing < count)]] = False
        upto = np.concatenate(([0], np.cumsum(inside)))
        return buckets[inside], upto[np.minimum(edges, count)]

    def means(self, texts: pa.Array, weights: np.ndarray, hasher: SpanHash) -> np.ndarray:
        """For each text the sum over kinds of the mean weight of its n-grams (a kind without any gives 0)."""
        out = np.zeros(len(texts))
        for buckets, edges in self.families(texts, hasher):
            sums = np.concatenate(([0.0], np.cumsum(weights[buckets], dtype=np.float64)))
            out += (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(1, np.diff(edges))
        return out

    def rows(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its distinct buckets and their values, the share of each in its kind."""
        kinds = list(self.families(texts, SpanHash()))
        out = []
        for i in range(len(texts)):
            parts = [b[e[i] : e[i + 1]] for b, e in kinds]
            index = np.concatenate(parts)
            value = np.concatenate([np.full(len(p), 1 / max(1, len(p)), np.float32) for p in parts])
            index, inverse = np.unique(index, return_inverse=True)
            out.append((index.astype(np.int32), np.bincount(inverse, value, len(index)).astype(np.float32)))
        return out


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    text: str = "text",
    doc_id: str = "doc_id",
    allowed: Column | None = None,
    max_rows: int = 2000,
    max_chars: int = 20_000,
) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of at most ``max_rows`` documents of at most ``max_chars`` characters.

    The rows are those of smallest hash of their id, so the sample is the same
    in each run. Null labels, null texts and ids that ``allowed`` excludes are
    left out; of several labels of an id the largest counts. Only ids and
    labels of four times as many rows, then the texts of the sample, come to
    the driver.
    """
    order = F.xxhash64("_id")
    chosen = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_label")).filter(
        "_id is not null and _label is not null"
    )
    if allowed is not None:
        chosen = chosen.filter(allowed)
    # About twice as many as needed go on, however many labels there are.
    chosen = chosen.filter(thinned(F.col("_id"), 8 * max_rows / max(1, chosen.count())))
    chosen = chosen.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(order, "_id").limit(4 * max_rows)
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    texts = texts.filter(f"_text is not null and length(_text) <= {max_chars}")
    # At most 4 * max_rows short rows: the bound makes it safe to broadcast.
    found = texts.join(F.broadcast(chosen), "_id").orderBy(order, "_id", F.xxhash64("_text")).limit(max_rows)
    rows = found.select("_text", "_label").collect()
    return [r["_text"] for r in rows], np.array([float(r["_label"] > 0) for r in rows])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
