"""Scores of the trained models against plain Python, and pipeline stages on awkward tables."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corroborate.llm import langid, quality_model, quality_rules
from corroborate.llm.common import SpanHash
from corroborate.llm.ngrams import _PRIMES, NGrams

SF = "/root/testdata/sf0.001"
LIMIT = (1 << 64) - 1
TEXTS = ["The cat sat on the  mat mat mat.", "Éa bB\n\tcc cc", "", None, "x", " \t ", "zażółć gęślą jaźń " * 30]


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & LIMIT
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & LIMIT
    return x ^ x >> 31


def bucket(units, bits):
    return mixed((len(units) + sum(u * int(p) for u, p in zip(units, _PRIMES))) & LIMIT) >> (64 - bits)


def mean_weights(text, grams, weights):
    """Sum over the kinds of n-grams of the mean weight of a text's n-grams."""
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    named = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in words]
    kinds = [[named[i : i + n] for i in range(len(named) - n + 1)] for n in grams.words]
    kinds.append([[1 + (i > 0 and words[i] == words[i - 1])] for i in range(len(words))])
    kinds += [[list(map(ord, text[i : i + n])) for i in range(len(text) - n + 1)] for n in grams.chars]
    return sum(float(np.mean([weights[bucket(u, grams.bits)] for u in units])) for units in kinds if units)


def test_means_of_ngram_weights():
    for grams in (NGrams(bits=12), NGrams(bits=12, words=(1, 2), chars=(2, 3, 4))):
        weights = np.random.default_rng(1).normal(size=grams.buckets).astype(np.float32)
        got = grams.means(pa.array(TEXTS, pa.large_string()), weights, SpanHash())
        assert np.allclose(got, [mean_weights(t, grams, weights) for t in TEXTS], atol=1e-5)


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_quality_verdicts_one_by_one(spark):
    """op9: the calibrated probability of each text, and what follows from it."""
    rng = np.random.default_rng(2)
    grams = NGrams(bits=10)
    model = quality_rules.Model(grams, rng.normal(size=grams.buckets).astype(np.float32), 0.3, 1.7, -0.2)
    long = [" ".join(f"word{i * k % 97}" for i in range(80)) for k in range(1, 9)]
    rows = list(enumerate(TEXTS + long))
    found = quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()
    kept = 0
    for r in found:
        expected = sigmoid(1.7 * (mean_weights(r["text"], grams, model.weights) + 0.3) - 0.2)
        assert abs(r["probability"] - expected) < 1e-5
        failed = r["n_words"] < 50 or r["n_repeat_words"] > 0.5 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["probability"] >= 0.2)
        kept += r["kept"]
    assert 0 < kept < len(long) + 1


def test_quality_scores_one_by_one(spark):
    """op10: averaged vectors of a text's n-grams, and softmax of the two labels' logits."""
    rng = np.random.default_rng(3)
    grams = NGrams(bits=9, words=(1, 2), chars=(2, 3, 4))
    vectors, output, bias = rng.normal(size=(grams.buckets, 4)).astype(np.float32), rng.normal(size=(2, 4)).astype(np.float32), np.array([0.1, -0.4], np.float32)
    model = quality_model.Embeddings(grams, vectors, output, bias)
    rows = list(enumerate(TEXTS))
    for r in quality_model.score(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect():
        hidden = np.array([mean_weights(r["text"], grams, vectors[:, k]) for k in range(4)]) / grams.kinds
        logits = output @ hidden + bias
        p = np.exp(logits - logits.max())
        assert abs(r["score"] - p[1] / p.sum()) < 1e-5


def test_single_precision_labels_are_those_of_the_trained_layers():
    """op6: the path that scores texts against the one that is trained."""
    rng = np.random.default_rng(4)
    net = langid.fresh_network(["a", "b", "c"], 8, rng)
    for w in net.parameters():
        w += rng.normal(0, 0.3, w.shape)
    lengths = np.concatenate((np.full(20, 64), rng.integers(1, 64, 30)))
    windows = rng.integers(0, 256, (50, 64)).astype(np.uint8) * (np.arange(64) < lengths[:, None])
    steps = list(windows.astype(np.uint8).T)
    live = [(lengths > t)[:, None].astype(np.float64) for t in range(64)]
    ahead = langid.run_layer(net.forward, steps, live)
    behind = langid.run_layer(net.backward, steps[::-1], live[::-1])[::-1]
    sums = np.zeros((50, 3))
    for a, b, alive in zip(ahead, behind, live):
        sums += langid.softmax(np.concatenate((a["out"], b["out"]), axis=1) @ net.output + net.bias) * alive
    assert np.allclose(langid.Labeller(net)(windows.astype(np.uint8), lengths), sums, atol=2e-3)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_and_empty_tables(spark, odd_docs, no_docs, name, stage):
    """Nulls, repeated rows, very long texts, extra columns of clashing names; and no rows at all."""
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", *[c for c in odd_docs.columns if c not in corpus_pipeline.COLUMNS])
    found = stage(spark, docs, SF)
    rows = found.collect()
    assert stage(spark, no_docs, SF).count() == 0
    if name == "token files":
        assert len(rows) == docs.count() and sum(r["n_tokens"] == 1 for r in rows) == 2
        return
    assert tuple(found.columns) == corpus_pipeline.COLUMNS
    texts = [r["text"] for r in rows]
    if name == "quality rules":
        assert all(t and len(t.split()) >= 50 for t in texts)
    if name == "near duplicates":
        assert sorted(t for t in texts if t and t.startswith("The quick")) == sorted({t for t in texts if t and t.startswith("The quick")})
        assert texts.count(None) == 1 and texts.count("") == 1
    if name == "benchmark decontamination":
        assert len(texts) == docs.count()
    if name == "mixing":
        assert None not in texts and all(t.strip() for t in texts)
