"""Cutting stock over a histogram of lengths, by column generation.

Class c of the histogram has width c units; a bin has as many units as there
are classes. The linear program minimises the number of bins, where a column
is a pattern: how many pieces of each class a bin holds. It starts with the
patterns of one class; the dual prices of its solution are the values of a
knapsack, whose dynamic program gives the pattern that lowers the number of
bins most, until none does. The solution is rounded down and what is left is
packed by the largest patterns that fit.
"""

from __future__ import annotations

import numpy as np


def best_pattern(prices: np.ndarray, widths: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern that fits into a bin, by dynamic programming over its units."""
    value, choice = np.zeros(units + 1), np.full(units + 1, -1)
    fits = np.searchsorted(widths, np.arange(units + 1), "right")
    for room in range(1, units + 1):
        value[room], choice[room] = value[room - 1], -1
        if fits[room]:
            worth = value[room - widths[: fits[room]]] + prices[: fits[room]]
            at = int(worth.argmax())
            if worth[at] > value[room]:
                value[room], choice[room] = worth[at], at
    pattern, room = np.zeros(len(widths), np.int64), units
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= int(widths[choice[room]])
    return float(value[units]), pattern


def fractional(counts: np.ndarray, widths: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns (one a row), how often each is used, and the prices of the optimum (revised simplex method)."""
    m = len(widths)
    patterns = np.diag(units // widths)
    inverse = np.diag(1.0 / (units // widths))
    used = counts / (units // widths)
    for _ in range(100 * m):  # far more than it takes; any state on the way is a plan as well
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(prices, widths, units)
        if value <= 1 + 1e-9:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-11, used / np.where(step > 1e-11, step, 1), np.inf)
        out = int(ratio.argmin())
        used = np.maximum(used - ratio[out] * step, 0)
        used[out] = ratio[out]
        patterns[out] = pattern
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
    return patterns, used, inverse.sum(axis=0)


def plan(counts: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Patterns over all classes and the number of bins of each; together they hold exactly ``counts[c - 1]`` pieces of class c."""
    counts = np.asarray(counts, np.int64)
    units, some = len(counts), np.flatnonzero(counts)
    if not len(some):
        return []
    widths, left = some + 1, counts[some].copy()
    patterns, used, _ = fractional(left, widths, units)
    out: list[tuple[np.ndarray, int]] = []

    def take(pattern: np.ndarray, most: int) -> None:
        nonlocal left
        held = pattern > 0
        times = min(most, int((left[held] // pattern[held]).min()))
        if times > 0:
            whole = np.zeros(units, np.int64)
            whole[some] = pattern
            out.append((whole, times))
            left = left - times * pattern

    for at in np.argsort(-used):
        take(patterns[at], int(used[at] + 1e-9))
    while left.any():
        pattern, room = np.zeros(len(widths), np.int64), units
        for at in range(len(widths) - 1, -1, -1):
            pattern[at] = min(left[at], room // widths[at])
            room -= int(pattern[at] * widths[at])
        take(pattern, units * int(counts.sum()))
    return out
