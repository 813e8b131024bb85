"""Importance resampling, packing and spelling variants against one-by-one versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corroborate.llm import cutting_stock, packing, resample, spelling
from corroborate.llm.crc import CrcShift
from corroborate.llm.fmindex import FmIndex
from corroborate.llm.token_files import load_tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


@given(st.lists(st.tuples(st.binary(max_size=300), st.binary(max_size=300)), min_size=1, max_size=8))
def test_crc_of_joined_strings(pairs):
    first = np.array([zlib.crc32(a) for a, _ in pairs], np.uint32)
    second = np.array([zlib.crc32(b) for _, b in pairs], np.uint32)
    joined = CrcShift()(first, np.array([len(b) for _, b in pairs])) ^ second
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in pairs]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB é\n.9" + "x" * 3, max_size=90)), max_size=6))
def test_buckets_of_word_runs(texts):
    n_words, found = resample.WordRuns(1000)(pa.array(texts, pa.large_string()))
    for i, text in enumerate(texts):
        n, own = features(text)
        got = [int(b) for buckets, edges in found for b in buckets[edges[i] : edges[i + 1]]]
        assert n_words[i] == n and got == [zlib.crc32(f.encode()) % 1000 for f in own]


def drawn_one_by_one(docs, target, buckets=10_000, least=20, percent=5):
    own = [features(r["text"]) for r in docs]
    here = Counter(zlib.crc32(f.encode()) % buckets for _, fs in own for f in fs)
    there = Counter(zlib.crc32(f.encode()) % buckets for r in target for f in features(r["text"])[1])
    s, t = sum(here.values()), sum(there.values())
    gain = {b: math.floor(1000 * math.log((there[b] + 1.0) * (s + buckets) / ((here[b] + 1.0) * (t + buckets)))) for b in here}
    rows = []
    for r, (n, fs) in zip(docs, own):
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs)
        name = "" if r["doc_id"] is None else r["doc_id"]
        h = int(hashlib.sha256(f"42:{name}".encode()).hexdigest()[:8], 16)
        rows.append((r["doc_id"], n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    count = percent * len(order) // 100
    ranked = [(*r[:1], *r[2:], k + 1 if k < count else None) for k, r in enumerate(order)]
    return Counter(ranked + [(*r[:1], *r[2:], None) for r in rows if r[1] < least])


def test_resampling_one_by_one(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    expected = drawn_one_by_one(docs.collect(), target.collect())
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    got = resample.resample(docs.repartition(5), target).select(*columns)
    assert Counter(map(tuple, got.collect())) == expected
    odd = resample.resample(odd_docs, target.filter("false"), least_words=1, percent=50)
    assert sorted(r["rank"] for r in odd.collect() if r["rank"]) == [1, 2, 3]
    assert resample.resample(no_docs, target).count() == 0


def test_equal_rows_are_split_between_segments(spark):
    rows = spark.range(3000).selectExpr("cast(7 as bigint) as score", "cast(null as bigint) as doc_id", "id").repartition(6)
    got = resample.rank_rows(rows, percent=100, segments=8)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 3001))


def one_error(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


WORDS = st.lists(st.text("abcé", min_size=5, max_size=9), min_size=1, max_size=40, unique=True)


@settings(max_examples=150, deadline=None)
@given(WORDS, WORDS)
def test_index_finds_all_words_one_error_away(words, queries):
    queries = queries + ["zzzzz", words[0], words[0][1:] + "b"]
    queries = [q for q in queries if len(q) >= 5]
    for reverse in (False, True):
        turn = [w[::-1] for w in words] if reverse else list(words)
        index = FmIndex(sorted(turn))
        asked = [q[::-1] for q in queries] if reverse else queries
        exact = np.array([spelling.exact_letters(len(q), reverse) for q in asked])
        got = {(int(q), index.words[int(w)]) for q, w in zip(*index.near(asked, exact))}
        expected = {(i, w) for i, q in enumerate(asked) for w in turn if one_error(q, w) and w.endswith(q[len(q) - exact[i] :])}
        assert got == expected


def variants_one_by_one(docs, least=5, times=3):
    counts = Counter()
    for r in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= least and k >= times}
    holes = defaultdict(set)
    for w in n:
        holes[w].add(w)
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if one_error(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda b: (-n[b], b), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return out


@pytest.mark.parametrize("block_words", [spelling.BLOCK_WORDS, 40])
def test_spelling_one_by_one(spark, odd_docs, no_docs, block_words):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    rows = docs.collect()
    expected = variants_one_by_one(rows)
    assert len(expected) > 300 and sum(r[3] is not None for r in expected) > 20
    found = spelling.group_variants(docs.repartition(3), typo_every=97, block_words=block_words)
    got = [tuple(r) for r in found.select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert spelling.group_variants(no_docs).count() == 0


def test_spelling_of_a_very_long_word_and_of_clashing_columns(spark):
    long = "ab" * 4000
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate([long, long, long, long[:-1], long[:-1], long[:-1]] + [long] * 4)], "doc_id int, text string, n int, word string")
    got = {r["word"]: (r["n"], r["form"]) for r in spelling.group_variants(docs).collect()}
    assert got == {long: (7, None), long[:-1]: (3, long)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=12, max_size=12))
def test_patterns_hold_all_pieces_and_are_near_the_optimum(counts):
    counts = np.array(counts)
    patterns = cutting_stock.plan(counts)
    held = sum((p * times for p, times in patterns), np.zeros(12, np.int64))
    assert held.tolist() == counts.tolist()
    assert all((p * np.arange(1, 13)).sum() <= 12 and times > 0 for p, times in patterns)
    some = np.flatnonzero(counts)
    if len(some):
        _, used, prices = cutting_stock.fractional(counts[some], some + 1, 12)
        value, _ = cutting_stock.best_pattern(prices, some + 1, 12)
        # No pattern is worth more than a bin, so the prices bound the number of bins from below.
        assert value <= 1 + 1e-6 and abs(used.sum() - prices @ counts[some]) < 1e-6
        assert sum(times for _, times in patterns) <= used.sum() + len(some)


def check_packing(found, docs, tokenizer, length, most_padding):
    ids = defaultdict(list)
    for r in docs:
        ids[r["doc_id"]].append([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    whole, places = defaultdict(list), defaultdict(list)
    for r in found:
        assert len(r["ids"]) == 4 * r["length"] > 0
        whole[r["doc_id"]].append((r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4").tolist()))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, copies in ids.items():
        expected = Counter((at, len(c), t) for c in copies for at, t in enumerate(c))
        assert Counter((start + i, n, t) for start, n, part in whole[doc_id] for i, t in enumerate(part)) == expected
    assert set(whole) == set(ids) and sorted(places) == list(range(len(places)))
    padding = 0
    for parts in places.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding <= most_padding * sum(n for parts in places.values() for _, n in parts)
    return places


def test_packing_round_trip(spark, odd_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = load_tokenizer(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    rows = docs.collect()
    packed = packing.pack(docs.repartition(3), path).collect()
    check_packing(packed, rows, tokenizer, 2048, 0)
    again = packing.pack(docs.repartition(5), path, length=64, step=8, block_ids=512)
    places = check_packing(again.collect(), rows, tokenizer, 64, 0.001)
    made = packing.sequences(again).collect()
    assert {r["sequence_id"]: r["piece_ends"] for r in made} == {s: [a + n for a, n in sorted(p)] for s, p in places.items()}
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in made)
    assert packing.pack(no_docs, path).count() == 0


def test_packing_of_short_documents_only(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(5)
    data = [(i if i % 3 else None, None if i % 11 == 0 else " ".join(["word"] * rng.choice([3, 50, 50, 50, 200, 333]))) for i in range(900)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    check_packing(packing.pack(docs, path).collect(), docs.collect(), load_tokenizer(path), 2048, 0.005)
    one = spark.createDataFrame([(1, "one two three")], "doc_id bigint, text string")
    check_packing(packing.pack(one, path).collect(), one.collect(), load_tokenizer(path), 2048, 0)
