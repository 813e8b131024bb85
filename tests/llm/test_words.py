"""Vectorised words, hashes and n-grams against plain Python."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corroborate.llm.bagminhash import BagMinHash, Shingler, overlap, weigh
from corroborate.llm.common import IS_TERM_BYTE, IS_TOKEN_BYTE, TERM, SpanHash, term_spans, terms, text_buffer, word_bounds
from corroborate.llm.quality_rules import BaseFigures

TEXTS = st.lists(st.one_of(st.none(), st.text("aB é\n\t.#9x|—", max_size=40)), max_size=8)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_base_figures(texts):
    got = BaseFigures()(pa.array(texts, pa.large_string()))
    assert [tuple(int(g[i]) for g in got) for i in range(len(texts))] == [figures(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_hashes(texts):
    array = pa.array(texts, pa.large_string())
    data, offsets = text_buffer(array)
    for flags, pattern in ((IS_TOKEN_BYTE, r"[^\x20\x09-\x0D]+"), (IS_TERM_BYTE, None)):
        starts, ends, first = word_bounds(data, offsets, flags)
        words = [bytes(data[a:b]) for a, b in zip(starts, ends)]
        for i, text in enumerate(texts):
            own = [w.decode() for w in words[first[i] : first[i + 1]]]
            expected = re.findall(pattern, text or "") if pattern else [(text or "")[a:b] for a, b in term_spans(text or "")]
            assert own == expected
        hashes = SpanHash()(data, starts, ends).tolist()
        assert len(set(hashes)) == len(set(words)) == len(set(zip(hashes, words)))


@given(st.text("aB é\n\t.#9x", max_size=40))
def test_terms(text):
    assert [w.decode() for w in terms(text)] == re.findall(TERM, lower(text))


def test_hash_of_a_very_long_word():
    data = np.frombuffer(b"x" * 700_000 + b" x " + b"x" * 700_000, np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), IS_TOKEN_BYTE)
    a, b, c = SpanHash()(data, starts, ends)
    assert a == c != b


def test_shingles_of_short_texts():
    got = Shingler(5)(pa.array(["a b c", "A, b c", "", None, "a b c d e f"], pa.large_string()))
    assert [len(x) for x in got] == [1, 1, 0, 0, 2]
    assert got[0] == got[1]


def test_signatures_are_unbiased_for_weighted_jaccard():
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 1 << 63, 80).astype(np.uint64))
    p = rng.integers(1, 40, len(x))
    q = np.maximum(0, p + rng.integers(-12, 12, len(x)))
    a, b = (x, p), (x[q > 0], q[q > 0])
    signed = BagMinHash(8192)([a, b, (x[:0], p[:0])])
    assert abs((signed[0] == signed[1]).mean() - overlap(a, b)) < 0.02
    assert not signed[2].any()


def test_overlap_of_multisets():
    a = weigh(np.array([1, 1, 2], np.uint64))
    b = weigh(np.array([1, 2, 2], np.uint64))
    assert overlap(a, b) == 2 / 4
    assert overlap(a, (np.array([], np.uint64), np.array([], np.int64))) == 0


def thue_morse(n, a, b):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


def test_words_with_equal_polynomial_hashes_stay_apart():
    """Such words of any length have equal sums of powers modulo 2**64, whatever the base."""
    for n in (1024, 2048):
        one, two = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
        texts = pa.array([f"{one}\n{two}\n", f"p q r {one} s t", f"p q r {two} s t"], pa.large_string())
        assert BaseFigures()(texts)[3].tolist() == [0, 0, 0]
        bags = [weigh(x) for x in Shingler()(texts)]
        assert overlap(bags[1], bags[2]) == 0
