"""BagMinHash signatures of word-shingle multisets, in numpy.

A document is a multiset of shingles: shingle d has weight w(d), the number of
its places. Picture for each shingle a strip of height w(d) over a time axis,
and m Poisson processes of rate 1 over each strip. Component k of the
signature is the earliest point of process k over all strips. Two documents
see the same points where their strips overlap, so component k is the same
point with probability sum(min) / sum(max), the weighted Jaccard similarity,
without bias.

The points of all m processes together are one process of rate m, each point
with a random k. The strip is cut into levels [0,1), [1,2), [2,4), [4,8) ...;
each level has a process of its own that depends on the shingle only, and a
point counts if its height is below the weight. So the cost grows with the
logarithm of a weight. Points are made in order of time and only up to a
horizon by which all m components have very probably been met: for n shingles
this takes n first points and about m * log(m) more, not n * m. A document
with a component that is still open gets a later horizon.
"""

from __future__ import annotations

import numpy as np

from corroborate.llm.common import IS_TERM_BYTE, LOWER_BYTES, SpanHash, mix64, text_buffer, word_bounds

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _gold(n: int) -> np.uint64:
    """The n-th multiple of the constant, modulo 2**64."""
    return np.uint64(n * int(_GOLD) & (1 << 64) - 1)


class Shingler:
    """Shingles of ``width`` words of a string array; shorter texts with words are one shingle."""

    def __init__(self, width: int = 5):
        self.width, self.hash = width, SpanHash()

    def __call__(self, texts) -> list[np.ndarray]:
        data, offsets = text_buffer(texts)
        data = LOWER_BYTES[data]
        starts, ends, first = word_bounds(data, offsets, IS_TERM_BYTE)
        words = self.hash(data, starts, ends)
        n = np.diff(first)
        joined = self.join(words, self.width)
        out = []
        for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
            if n[i] >= self.width:
                out.append(joined[a : b - self.width + 1])
            else:
                out.append(self.join(words[a:b], int(n[i])) if n[i] else words[:0])
        return out

    @staticmethod
    def join(words: np.ndarray, width: int) -> np.ndarray:
        count = max(0, len(words) - width + 1)
        total = np.full(count, _gold(width), np.uint64)
        for i in range(width):
            total = mix64(total + words[i : i + count])
        return total


def weigh(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order and their weights."""
    return np.unique(shingles, return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighed multisets; 0 if one is empty."""
    (x, p), (y, q) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = np.minimum(p, q[at])[y[at] == x].sum()
    return float(both / (p.sum() + q.sum() - both))


class BagMinHash:
    def __init__(self, components: int = 192, at_once: int = 64):
        self.m, self.at_once = components, at_once  # a text has thousands of points, so few texts are signed together

    def __call__(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One row of ``m`` 64-bit point names for each multiset; empty ones give zeros."""
        out = np.zeros((len(bags), self.m), np.uint64)
        some = [i for i, (x, _) in enumerate(bags) if len(x)]
        for at in range(0, len(some), self.at_once):
            self.sign(bags, np.array(some[at : at + self.at_once], np.int64), out)
        return out

    def sign(self, bags, todo: np.ndarray, out: np.ndarray) -> None:
        slack = 3.0
        while len(todo):
            shingle = np.concatenate([bags[i][0] for i in todo])
            weight = np.concatenate([bags[i][1] for i in todo]).astype(np.float64)
            row = np.repeat(np.arange(len(todo)), [len(bags[i][0]) for i in todo])
            total = np.bincount(row, weight)
            names, times = self.points(shingle, weight, row, len(todo), (np.log(self.m) + slack) / total)
            done = np.isfinite(times).all(axis=1)
            out[todo[done]] = names[done]
            todo, slack = todo[~done], slack * 2

    def points(self, shingle, weight, row, rows, horizon) -> tuple[np.ndarray, np.ndarray]:
        names = np.zeros((rows, self.m), np.uint64)
        times = np.full((rows, self.m), np.inf)
        low, high = 0.0, 1.0
        found = []
        while len(shingle):
            seed = mix64(shingle ^ _gold(int(high)))
            found += self.level(seed, weight, row, horizon, low, high)
            keep = weight > high
            shingle, weight, row = shingle[keep], weight[keep], row[keep]
            low, high = high, 2 * high
        r, k, t, name = (np.concatenate(x) for x in zip(*found))
        latest_first = np.argsort(-t)
        r, k, t, name = r[latest_first], k[latest_first], t[latest_first], name[latest_first]
        names[r, k], times[r, k] = name, t  # of several points of a component the earliest is written last
        return names, times

    def level(self, seed, weight, row, horizon, low, high):
        """Points of the strips' part between heights ``low`` and ``high``, as far as the horizon.

        Most strips of a long text have no point before the horizon, the few
        of a short one have many, so twice as many are drawn in each step.
        """
        rate = self.m * (high - low)
        time, done, count = np.zeros(len(seed)), 0, 1
        while len(seed):
            steps = np.arange(done + 1, done + count + 1, dtype=np.uint64) * _GOLD
            draw = mix64(seed[:, None] + steps)
            gaps = -np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / rate
            gaps[:, 0] += time
            times = np.cumsum(gaps, axis=1)
            near = times <= horizon[row][:, None]
            i, j = np.nonzero(near)
            name = mix64(draw[i, j] ^ _GOLD)
            height = low + (mix64(name) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * (high - low)
            inside = height < weight[i]
            i, name = i[inside], name[inside]
            yield row[i], (name % np.uint64(self.m)).astype(np.int64), times[i, j[inside]], name
            more = near[:, -1]
            seed, weight, row, time = seed[more], weight[more], row[more], times[more, -1]
            done, count = done + count, min(2 * count, 256)


def band_keys(signatures: np.ndarray, rows_per_band: int) -> np.ndarray:
    """A 64-bit key for each band of a signature; the band's number is part of it."""
    bands = signatures.reshape(len(signatures), -1, rows_per_band)
    key = mix64(np.arange(1, bands.shape[1] + 1, dtype=np.uint64) * _GOLD)[None, :] + np.zeros((len(bands), 1), np.uint64)
    for j in range(rows_per_band):
        key = mix64(key ^ bands[:, :, j])
    return key
