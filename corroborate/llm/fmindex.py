"""FM-index over a delimited vocabulary, and the search of many words with one error, in numpy.

The text is all words in code point order, each followed by a delimiter. Its
suffixes are sorted; those that start with a pattern are an interval of ranks.
``extend`` puts a symbol before the patterns of many intervals at once. Rows
that start with a delimiter and a word stand at that word's number, so a whole
word's interval names it.

An index over words and one over reversed words are the two directions of a
bidirectional index. A single error lies in one half of a word, so each
direction's search matches one half exactly and goes on across the other
half allowing the error.
"""

from __future__ import annotations

import numpy as np


def points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row and the edges of each word."""
    edges = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), edges


class FmIndex:
    """``words``: distinct, not empty, in code point order."""

    def __init__(self, words: list[str]):
        self.words, count = words, len(words)
        codes, edges = points(words)
        self.alphabet = np.unique(codes)
        self.symbols = len(self.alphabet)
        self.n = n = len(codes) + count
        ends = edges[1:] + np.arange(count)  # places of the delimiters, symbol 0
        text = np.zeros(n, np.int64)
        letters = np.ones(n, bool)
        letters[ends] = False
        text[letters] = np.searchsorted(self.alphabet, codes) + 1
        # A delimiter ranks by the word after it (after the last word comes the first).
        rank = text + count
        rank[ends] = (np.arange(count) + 1) % count
        width = 1
        while True:
            found, rank = np.unique(rank * (n + count + self.symbols + 1) + np.roll(rank, -width), return_inverse=True)
            if len(found) == n:
                break
            width *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        self.before = text[order - 1]  # the symbol before each suffix
        rows = np.argsort(self.before, kind="stable")
        self.keys = self.before[rows] * n + rows

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank intervals of the patterns with a symbol put before them."""
        at = symbol * self.n
        return np.searchsorted(self.keys, at + low), np.searchsorted(self.keys, at + high)

    def branch(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All letters that stand before the patterns: which pattern, the letter, and the new interval."""
        wide = high - low > self.symbols
        narrow = np.flatnonzero(~wide)
        sizes = (high - low)[narrow]
        upto = np.cumsum(sizes)
        rows = np.arange(upto[-1] if len(upto) else 0) + np.repeat(low[narrow] - upto + sizes, sizes)
        pairs = np.unique(np.repeat(narrow, sizes) * (self.symbols + 1) + self.before[rows])
        some = np.repeat(np.flatnonzero(wide), self.symbols)
        which = np.concatenate((pairs // (self.symbols + 1), some))
        letter = np.concatenate((pairs % (self.symbols + 1), np.tile(np.arange(1, self.symbols + 1), len(some) // max(1, self.symbols))))
        which, letter = which[letter > 0], letter[letter > 0]
        a, b = self.extend(letter, low[which], high[which])
        full = a < b
        return which[full], letter[full], a[full], b[full]

    def near(self, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) by number: the word is one error away, and the query's last ``exact`` letters are its end."""
        codes, edges = points(queries)
        symbol = np.searchsorted(self.alphabet, codes)
        known = self.alphabet[np.minimum(symbol, self.symbols - 1)] == codes
        symbol = np.where(known, symbol + 1, self.symbols + 1)  # one that no word has
        size = np.diff(edges)
        first, enter = edges[:-1], size - exact - 1  # the place of the last letter before the exact part
        query = np.arange(len(queries))
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.words))
        for step in range(int(exact.max(initial=0))):
            going = np.flatnonzero(exact[query] > step)
            place = first[query[going]] + size[query[going]] - 1 - step
            low[going], high[going] = self.extend(symbol[place], low[going], high[going])
            if step % 2:  # those that nothing matches go
                full = low < high
                query, low, high = query[full], low[full], high[full]
        full = low < high
        query, low, high = query[full], low[full], high[full]
        free = (np.zeros(0, np.int64),) * 3  # no error yet, next letter is at place ``i``
        spent = (np.zeros(0, np.int64),) * 3  # one error made
        for i in range(int(enter.max(initial=-1)), -2, -1):
            new = enter[query] == i
            free = _join(free, (query[new], low[new], high[new]))
            if not len(free[0]) and not len(spent[0]):
                continue
            q, a, b = free
            which, letter, c, d = self.branch(a, b)
            spent = _join(spent, (q[which], c, d))  # a letter too many in the word
            here = q[which], letter, c, d
            if i < 0:
                break
            own = symbol[first[spent[0]] + i]
            spent = _full(spent[0], *self.extend(own, spent[1], spent[2]))
            spent = _join(spent, free)  # the query's letter is missing in the word
            other = here[1] != symbol[first[here[0]] + i]
            spent = _join(spent, (here[0][other], here[2][other], here[3][other]))
            free = _full(q, *self.extend(symbol[first[q] + i], a, b))
        q, a, b = spent
        q, word, _ = _full(q, *self.extend(np.zeros(len(q), np.int64), a, b))
        pairs = np.unique(q * len(self.words) + word)
        return pairs // len(self.words), pairs % len(self.words)


def _join(a, b):
    return tuple(np.concatenate(x) for x in zip(a, b))


def _full(query, low, high):
    some = low < high
    return query[some], low[some], high[some]
