"""Mixed-cost ledger, admitting limiter and similarity join against one-by-one versions."""

import datetime as dt
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corroborate.config import Limits
from corroborate.operators import quota as Q
from corroborate.operators import similarity as S
from corroborate.session import cut_lineage, stored

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("seed", range(3))
def test_mixed_costs_against_a_fold(spark, seed):
    rng = random.Random(seed)
    caps = {"a": 30, "b": 5, "c": 100, "d": 0}
    rows = []
    for i in range(600):
        at = T0 + dt.timedelta(seconds=rng.randint(0, 900))
        day = rng.choice(["d1", "d1", "d1", "d2", None])
        rows.append((day, rng.choice(["a", "a", "b", "c", "d", "e"]), at, i, rng.choice([1, 2, 7, 30, 90, 0, -5, 500, None])))
    calls = spark.createDataFrame(rows, "day string, stage string, ts timestamp, call_id bigint, cost int")
    pairs = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    got = Q.admit_mixed_costs(calls, 400, F.try_element_at(pairs, F.col("stage"))).collect()
    spent, used, expected = {}, {}, {}
    for day, stage, _, call, cost in sorted(rows, key=lambda r: (r[2], r[3])):
        ok = cost is not None and 0 < cost <= 400 and used.get((day, stage), 0) < caps.get(stage, 0) and spent.get(day, 0) + cost <= 400
        if ok:
            spent[day] = spent.get(day, 0) + cost
            used[day, stage] = used.get((day, stage), 0) + 1
        expected[call] = ok
    assert {r.call_id: r.admitted for r in got} == expected and len(got) == len(rows)
    assert 20 < sum(expected.values()) < 300


def test_mixed_costs_of_nothing(spark):
    calls = spark.createDataFrame([("d", "a", T0, 1, 900)], "day string, stage string, ts timestamp, call_id bigint, cost int")
    assert [r.admitted for r in Q.admit_mixed_costs(calls, 400, F.lit(5)).collect()] == [False]
    assert Q.admit_mixed_costs(calls.filter("false"), 400, F.lit(5)).count() == 0


def limiter_fold(rows, start, limits):
    """What the limiter answers one candidate after the other."""
    published, out = {}, {}
    for channel, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if at < start:
            out[i] = (None, None, None, "before_start")
            continue
        mine = published.setdefault(channel, [])
        cycle_start = T0 + dt.timedelta(seconds=(at - T0).total_seconds() // 300 * 300)
        total, hourly, cycle = len(mine), sum(t >= at - dt.timedelta(hours=1) for t in mine), sum(t >= cycle_start for t in mine)
        reason = "allowed"
        if total >= limits.publish_total:
            reason = "canary_total_exhausted"
        elif hourly >= limits.publish_per_hour:
            reason = "canary_hour_exhausted"
        elif cycle >= limits.publish_per_cycle:
            reason = "canary_cycle_exhausted"
        else:
            mine.append(at)
        out[i] = (total, hourly, cycle, reason)
    return out


@pytest.mark.parametrize("limits", [Limits(publish_total=25, publish_per_hour=5, publish_per_cycle=2), Limits(publish_total=9, publish_per_hour=9, publish_per_cycle=9)])
def test_limiter_against_a_fold(spark, limits):
    rng = random.Random(7)
    rows, at = [], T0
    for i in range(700):
        at += dt.timedelta(seconds=rng.choice([0, 20, 60, 290, 600, 3600, 3601, 9000] if rng.random() < 0.2 else [0, 15, 60]))
        rows.append((rng.choice(["busy", "busy", "busy", "quiet", None]), at, i))
    start = T0 + dt.timedelta(minutes=7)
    frame = spark.createDataFrame(rows, "channel string, at timestamp, candidate_id bigint")
    got = Q.admit_publications(frame.repartition(3), F.lit(start), limits).collect()
    expected = limiter_fold(rows, start, limits)
    assert {r.candidate_id: (r.total, r.hourly, r.cycle, r.reason) for r in got} == expected
    assert all(r.allowed == (r.reason == "allowed") for r in got)
    if limits.publish_per_cycle == 2:
        assert len({e[3] for e in expected.values()}) == 5


def test_limiter_without_start_or_configuration(spark):
    frame = spark.createDataFrame([("c", T0, 1)], "channel string, at timestamp, candidate_id bigint")
    never = F.lit(None).cast("timestamp")
    answers = [
        Q.admit_publications(frame, never, Limits()),
        Q.admit_publications(frame, F.lit(T0), Limits(publish_per_hour=0)),
        Q.admit_publications(frame, F.lit(T0), Limits(), enabled=False),
    ]
    assert [(r.reason, r.allowed) for a in answers for r in a.collect()] == [
        ("canary_configuration_invalid", False),
        ("canary_configuration_invalid", False),
        ("canary_disabled", True),
    ]
    assert Q.admit_publications(frame.filter("false"), F.lit(T0), Limits()).count() == 0


@pytest.mark.parametrize("threshold, group_sets", [(0.86, 1000), (0.6, 3)])
def test_similarity_join_one_by_one(spark, threshold, group_sets):
    rng = random.Random(11)
    base = [[f"t{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(rng.randint(1, 30))] for _ in range(25)]
    rows = []
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        rows.append((i, sorted(set(words), key=lambda w: rng.random())))
    rows += [(500, []), (501, None)]
    sets = spark.createDataFrame(rows, "post_id bigint, tokens array<string>")
    classes = {r.post_id: r.class_id for r in S.set_classes(sets).collect()}
    named = {}
    for i, words in rows:
        if words:
            named.setdefault(frozenset(words), []).append(i)
    assert classes == {i: min(ids) for ids in named.values() for i in ids}
    firsts = [(min(ids), words) for words, ids in named.items()]
    expected = {}
    for a, x in firsts:
        for b, y in firsts:
            if a < b and len(x & y) / max(len(x), len(y)) >= threshold:
                expected[a, b] = len(x & y) / max(len(x), len(y))
    frame = spark.createDataFrame([(i, sorted(w)) for i, w in firsts], "id bigint, tokens array<string>")
    found = S.similar_sets(frame, threshold, group_sets).collect()
    assert {(r.left_id, r.right_id): r.overlap for r in found} == expected and len(found) == len(expected) > 20
    links = S.copy_links(sets, threshold)
    assert {(r.left_id, r.right_id) for r in links.collect()} == set(expected)
    assert S.copy_links(sets.filter("false"), threshold).count() == 0


def test_a_set_travels_once_for_its_neighbourhood(spark):
    rng = random.Random(3)
    words = [f"t{i}" for i in range(400)]
    sets = [(i, rng.sample(words, 380)) for i in range(60)] + [(100 + i, [f"u{i}", f"u{i + 1}"]) for i in range(5)]
    frame = spark.createDataFrame(sets, "id bigint, tokens array<string>")
    pairs = spark.createDataFrame([(a, b) for a, _ in sets for b, _ in sets if a < b and (b < 60 or b == a + 1)], "left_id bigint, right_id bigint")
    for group_sets in (1000, 7):
        found = {(r.left_id, r.right_id): r.overlap for r in S.checked_pairs(pairs, frame, 0.5, group_sets).collect()}
        tokens = {i: set(t) for i, t in sets}
        assert found == {(a, b): len(tokens[a] & tokens[b]) / 380 for a in range(60) for b in range(a + 1, 60)} | {(100 + i, 101 + i): 0.5 for i in range(4)}
    assert S.checked_pairs(pairs.filter("false"), frame, 0.5).count() == 0


def test_large_sets_with_a_rare_token_in_common_are_no_candidates(spark, monkeypatch):
    """A few parities are all used up by large sets: then each rare token in common sent both sets to be compared."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(20_000)]
    sets = [(i, ["rare", *rng.sample(words, 700 + 40 * (i % 5))]) for i in range(40)]
    copies = [(100 + i, [*t[:-1 - i], f"n{i}"]) for i, t in sets[:10]]
    frame = spark.createDataFrame(sets + copies, "id bigint, tokens array<string>")
    asked = []
    checked = S.checked_pairs
    monkeypatch.setattr(S, "checked_pairs", lambda pairs, *rest: asked.extend(map(tuple, pairs.collect())) or checked(pairs, *rest))
    found = {(r.left_id, r.right_id) for r in S.similar_sets(frame, 0.86).collect()}
    assert found == set(asked) == {(i, 100 + i) for i in range(10)}


def test_parities_bound_what_only_one_set_has(spark):
    """Also between sets of different numbers of parities, which fold."""
    rng = random.Random(9)
    hashes = [[rng.randrange(-(2**63), 2**63) for _ in range(n)] for n in (300, 350, 400, 430, 780, 820, 1700, 1500)]
    size = np.array([len(h) for h in hashes])
    longs = S.parity_longs(size, 0.86)
    assert list(longs) == [4, 4, 8, 8, 8, 16, 32, 16]
    rows = []
    for i, j, shared in ((2, 3, 390), (4, 5, 700), (7, 6, 1450), (0, 2, 250), (5, 6, 10)):
        x, y = hashes[i], hashes[i][:shared] + hashes[j][shared:]
        x, y = [[int(w) for w in S._parities(np.array(h), np.zeros(len(h), "int64"), 1, int(n))[0]] for h, n in ((x, longs[i]), (y, longs[j]))]
        rows.append((x, y, len(hashes[i]) + len(hashes[j]) - 2 * shared))
    frame = spark.createDataFrame(rows, "x array<bigint>, y array<bigint>, alone int")
    got = [(r.n, r.m, r.alone) for r in frame.select(S._apart(F.col("x"), F.col("y")).alias("n"), S._apart(F.col("y"), F.col("x")).alias("m"), "alone").collect()]
    assert all(n == m and n <= alone and (n - alone) % 2 == 0 for n, m, alone in got)
    assert all(n > 0 for n, _, _ in got) and got[4][0] > 400


def test_what_is_stored_leaves_no_shuffle_files(spark):
    """Shuffle files of a step that was written stayed until the driver collected its garbage."""
    def files():
        folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for folder in folders for f in Path(folder).glob("*/shuffle_*")}

    before = files()
    rows = spark.range(1000).repartition(7, "id")
    made = [stored(rows), cut_lineage(rows)]
    left = set()
    for _ in range(50):  # files go in the background
        left = {f for f in files() - before if f.suffix == ".data"}
        if not left:
            break
        time.sleep(0.1)
    assert not left and [df.count() for df in made] == [1000, 1000]
