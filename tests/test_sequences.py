"""Blocked operators against plain folds, with one key holding most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corroborate.config import Limits
from corroborate.functions.text import tokens
from corroborate.operators import blocks as K
from corroborate.operators import editorial as X
from corroborate.operators import evidence as V
from corroborate.operators import quota as Q
from corroborate.operators.batches import pack_windows, window_reports

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [(i, None if i % 50 == 0 else "hot" if rng.random() < 0.6 else f"k{i % 7}", rng.randint(-3, 9), rng.choice([None, i])) for i in range(2000)]
    return spark.createDataFrame(rows, "id bigint, key string, value bigint, maybe bigint")


def test_running_sum_and_previous_value(skewed):
    window = Window.partitionBy("key").orderBy("id")
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    plain = skewed.select("id", F.sum("value").over(upto).alias("s"), F.last("maybe", True).over(before).alias("p"))
    block = K.id_block(F.col("id"), 37)
    summed = K.running_sum(skewed, ["key"], ["id"], block, F.col("value"), "s").select("id", "s")
    previous = K.previous_value(skewed, ["key"], ["id"], block, F.col("maybe"), "p").select("id", "p")
    assert sorted(summed.collect()) == sorted(plain.select("id", "s").collect())
    assert {r.id: r.p for r in previous.collect()} == {r.id: r.p for r in plain.collect()}


def test_distribution_matches_sorted_lists(skewed):
    rows = K.distribution(skewed.fillna("none", ["key"]), ["key"], "value", {"p95": 0.95}, 5).collect()
    values = {}
    for r in skewed.fillna("none", ["key"]).collect():
        values.setdefault(r.key, []).append(r.value)
    for r in rows:
        v = sorted(values[r.key])
        n = len(v)
        assert r.samples == n and r.maximum == v[-1]
        assert r.median == (v[(n - 1) // 2] + v[n // 2]) / 2
        assert r.p95 == v[max(0, -(-n * 95 // 100) - 1)]


def test_values_of_a_narrow_range_fall_into_many_blocks(spark):
    rows = spark.range(20_000).select((F.col("id") / 20_000).alias("value"))
    placed = K.quantile_block(rows.withColumn("key", F.lit("k")), ["key"], "value", 16, "block")
    sizes = [r["count"] for r in placed.groupBy("block").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16
    spread = K.distribution(rows, [], "value", {"p95": 0.95}).first()
    assert (spread.samples, spread.median, spread.p95, spread.maximum) == (20_000, 9_999.5 / 20_000, 18_999 / 20_000, 19_999 / 20_000)


def test_reports_are_not_dealt_out_by_their_few_sources(spark):
    """A short table of sources is sent to the posts' tasks; a long one is shuffled, with the same result."""
    posts = spark.range(400).select(
        F.col("id").alias("post_id"), (F.col("id") % 3).alias("source_id"), F.lit(False).alias("is_deleted"), F.lit(False).alias("is_noise"),
        F.timestamp_seconds(F.col("id") * 60).alias("published_at"), F.timestamp_seconds(F.col("id") * 60).alias("observed_at"),
        F.repeat(F.lit("text "), F.col("id").cast("int")).alias("normalized_text"), F.lit("x").alias("original_text"),
    )
    sources = spark.range(2).select(F.col("id").alias("source_id"), F.concat(F.lit("Channel "), "id").alias("name"))
    named = sources.select("source_id", F.col("name").alias("source_name"))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")  # as where Spark does not know that the table is short
    try:
        reports, long = window_reports(posts, sources), K.join_few(posts, named, "source_id", most=1)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (reports, long)]
    finally:
        spark.conf.unset(threshold)
    assert ["hashpartitioning(source_id" in plan for plan in plans] == [False, True]
    assert sorted(long.select("post_id", "source_name").collect()) == sorted(K.join_few(posts, named, "source_id").select("post_id", "source_name").collect())
    assert reports.count() == 267


@pytest.mark.parametrize("block_rows", [32, 50, 4096])
def test_window_packing_against_a_fold(spark, block_rows):
    rng = random.Random(block_rows)
    rows = [(T0, i, rng.choice([5, 40, 90])) for i in range(400)] + [(T0 + dt.timedelta(minutes=5), 1000 + i, 10) for i in range(33)]
    frame = spark.createDataFrame(rows, "window_end timestamp, post_id bigint, size bigint")
    frame = frame.withColumn("seen_at", F.timestamp_seconds(F.floor(F.col("post_id") / 3)))
    expected, state = {}, {}
    for w, post, size in sorted(rows, key=lambda r: -r[1]):  # newest first
        held, chars, seq = state.get(w, (0, 0, 0))
        if held and (held >= 8 or 2 + chars + size + held > 300):
            held, chars, seq = 0, 0, seq + 1
        state[w] = (held + 1, chars + size, seq)
        expected[post] = seq
    packed = pack_windows(frame, max_rows=8, max_chars=300, block_rows=block_rows)
    assert {r.post_id: r.batch_sequence for r in packed.collect()} == expected


def test_cost_ledger_against_a_fold(spark):
    rng = random.Random(9)
    caps = {"a": 4, "b": 7, "c": 0}
    calls = [(i, T0 + dt.timedelta(minutes=i), f"2024-01-0{1 + i // 200}", rng.choice("aaabbc")) for i in range(400)]
    ledger, used, expected = {}, {}, {}
    for call, _, day, stage in calls:
        ok = used.get((day, stage), 0) < caps[stage] and ledger.get(day, 0) + 500 <= 4_500
        if ok:
            ledger[day] = ledger.get(day, 0) + 500
            used[day, stage] = used.get((day, stage), 0) + 1
        expected[call] = ok
    frame = spark.createDataFrame(calls, "call_id bigint, ts timestamp, day string, stage string")
    cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])[F.col("stage")]
    got = {r.call_id: r.admitted for r in Q.admit_costs(frame, 500, 4_500, cap).collect()}
    assert got == expected
    assert not any(r.admitted for r in Q.admit_costs(frame, 9_000, 8_000, cap).collect())


def test_daily_cap_boundary(spark):
    calls = spark.range(1, 1402).select(F.col("id").alias("call_id"), F.timestamp_seconds("id").alias("ts"), F.lit("d").alias("day"), F.lit("pair").alias("stage"))
    rows = Q.admit_calls(calls.unionByName(calls.withColumn("stage", F.lit("other"))), F.lit(1_400)).filter("not admitted").collect()
    assert sorted((r.call_id, r.stage) for r in rows) == [(1401, "other"), (1401, "pair")]


def test_limiter_order_and_failed_attempts(spark):
    def decide(rows, **limits):
        frame = spark.createDataFrame(rows, "published_at timestamp, updated_at timestamp")
        now = F.lit(T0 + dt.timedelta(hours=3, minutes=2))
        return Q.limiter_decision(frame, F.lit(T0), now, Limits(**limits)).first()

    at = lambda h, m=0: T0 + dt.timedelta(hours=h, minutes=m)
    assert decide([(at(0), at(0))]).reason == "allowed"
    assert decide([(None, at(3, 1))]).reason == "canary_cycle_exhausted"
    assert decide([(at(2, 10), at(2, 10)), (None, at(2, 50))]).reason == "canary_hour_exhausted"
    assert decide([(at(h), at(h)) for h in (0, 0, 0, 1, 1)]).reason == "canary_total_exhausted"
    assert decide([(at(-1), at(-1))]).total == 0


def test_limiter_switched_off_or_not_configured(spark):
    frame = spark.createDataFrame([(T0, T0)] * 9, "published_at timestamp, updated_at timestamp")
    start, now = F.lit(T0), F.lit(T0 + dt.timedelta(minutes=1))
    answer = lambda *args, **more: tuple(Q.limiter_decision(frame, *args, **more).first())
    assert answer(start, now, enabled=False) == (0, 0, 0, "canary_disabled", True)
    invalid = (0, 0, 0, "canary_configuration_invalid", False)
    assert answer(start, now, Limits(publish_total=0)) == invalid
    assert answer(F.lit(None).cast("timestamp"), now) == invalid
    assert answer(start, now) == (9, 9, 9, "canary_total_exhausted", False)


def test_lock_of_an_earlier_run_wins(spark):
    jobs = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1), (2, "e", 2), (3, "f", 1)], "event_id bigint, publish_key string, created_at bigint")
    stories = spark.createDataFrame([], "event_id bigint, publish_key string, publication_state string")
    locks = spark.createDataFrame([(1, "a", "failed"), (2, "e", "processing")], "event_id bigint, publish_key string, status string")
    won = lambda *more: sorted(r.publish_key for r in X.claim_publication(jobs, stories, *more).filter("status = 'processing'").collect())
    assert won(locks) == ["e", "f"]
    assert won() == ["b", "d", "f"]


def test_copies_against_a_fold_in_one_crowded_event(spark):
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(40)]
    texts = []
    for i in range(300):
        base = rng.choice(texts[-40:]) if texts and rng.random() < 0.5 else " ".join(rng.sample(vocabulary, 12))
        words = base.split()
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    sets = [set(t.split()) for t in texts]
    expected = {}
    for i, mine in enumerate(sets):
        for j in range(i - 1, max(-1, i - 31), -1):
            if len(mine & sets[j]) / max(len(mine), len(sets[j])) >= 0.86:
                expected[i] = j
                break
    rows = [(1, i, T0 + dt.timedelta(minutes=13 * i), t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "event_id bigint, post_id bigint, attached_at timestamp, text string")
    got = {r.post_id: r.parent_post_id for r in V.copied_from(frame).collect()}
    assert got == expected and len(expected) > 50
    # lineage: every copy inherits the group at the end of its chain, unless it has its own origin
    profile = frame.withColumns(
        {
            "source_id": F.col("post_id"),
            "source_key": F.lit("k"),
            "is_wire_origin": F.lit(False),
            "role": F.lit("specialist"),
            "metadata": F.when(F.col("post_id") % 9 == 0, F.lit('{"cited_source":"reuters"}')).otherwise(F.lit("{}")),
        }
    )
    copies = spark.createDataFrame([(1, a, b) for a, b in expected.items()], "event_id bigint, post_id bigint, parent_post_id bigint")
    groups = {r.post_id: r.origin_group for r in V.propagate_origins(profile, copies).collect()}
    wanted = {}
    for i in range(300):
        wanted[i] = "origin:reuters" if i % 9 == 0 else wanted[expected[i]] if i in expected else f"source:{i}"
    assert groups == wanted


EVIDENCE = "event_id bigint, source_id bigint, origin_group string, origin_type string, priority_tier string, trust_score double, text string"


@pytest.mark.parametrize(
    "rows, status, confirmations",
    [
        ([(1, "g", "unknown", "TIER_2", 0.6, "x"), (2, "g", "unknown", "TIER_2", 0.6, "x")], "DEVELOPING", 1),
        ([(1, "g", "unknown", "TIER_2", 0.6, "x"), (2, "h", "unknown", "TIER_2", 0.6, "x")], "CONFIRMED", 2),
        ([(1, "g", "unknown", "TIER_2", 0.6, "x"), (2, "h", "unknown", "TIER_2", 0.6, "officials denied it")], "DISPUTED", 1),
        ([(1, "g", "unknown", "TIER_2", 0.6, "it is fake")], "UNVERIFIED", 0),
        ([(1, "g", "aggregation", "TIER_2", 0.9, "x")], "UNVERIFIED", 0),
        ([(1, "g", "aggregation", "TIER_1", 0.1, "x")], "DEVELOPING", 1),
        ([(1, "g", "unknown", "TIER_3", 0.54, "x")], "UNVERIFIED", 0),
    ],
)
def test_verification(spark, rows, status, confirmations):
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame([(1, *r) for r in order], EVIDENCE)
        got = V.verify_events(V.origin_groups(frame)).first()
        assert (got.verification_status, got.independent_confirmation_count, got.source_count) == (status, confirmations, len(rows))


def test_update_classes(spark):
    rows = [(1, 1, "f", "DEVELOPING", 70), (1, 2, "f", "DEVELOPING", 70), (1, 3, "f", "DISPUTED", 70), (1, 4, "g", "DISPUTED", 55), (1, 5, "g", "DISPUTED", 70), (1, 6, "g", "DISPUTED", 71)]
    history = spark.createDataFrame(rows, "event_id bigint, event_version bigint, core_fact string, verification_status string, importance_score bigint")
    got = [r.update_type for r in X.version_changes(history, 2).orderBy("event_version").collect()]
    assert got == [None, "NO_CHANGE", "CONTRADICTION", "CORRECTION", "MAJOR_UPDATE", "MINOR_UPDATE"]


def test_tokens_are_distinct(value):
    assert value(tokens(F.col("s")), s="a bb bb cc") == ["bb", "cc"]


def test_queries_claim_only_rows_they_exercise():
    from corroborate.catalog import load

    rows = {name: set(query.survey) for name, query in load().items()}
    assert "J1" not in rows["stream_fingerprints"] and not {"H6", "H8"} & rows["sql_functions"]
