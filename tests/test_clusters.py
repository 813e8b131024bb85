import itertools
import random

import pytest
from pyspark.sql import functions as F

from corroborate.operators import clusters as C
from corroborate.operators import decisions as D
from corroborate.schemas import DECISIONS, PROPOSALS


def split(ids, pairs):
    edges = sorted((a, b, c) for a, b, c in pairs)
    return [(members, anchor) for members, anchor, _ in C.stars(ids, edges)]


def test_middle_post_is_anchor():
    assert split([11, 12, 13], [(11, 12, 0.99), (12, 13, 0.98)]) == [([11, 12, 13], 12)]


def test_chain_is_not_merged_transitively():
    got = split([1, 2, 3, 4], [(1, 2, 0.97), (2, 3, 0.97), (3, 4, 0.97)])
    assert got == [([1, 2, 3], 2), ([4], 4)]


def test_no_edges_gives_singletons():
    assert split([5, 9], []) == [([5], 5), ([9], 9)]


def test_ties_go_to_weight_then_smaller_id():
    assert split([1, 2, 3, 4], [(1, 2, 0.95), (3, 4, 0.99)])[0][1] == 3
    assert split([1, 2, 3, 4], [(1, 2, 0.95), (3, 4, 0.95)])[0][1] == 1


def brute_stars(ids, edges):
    left, out = sorted(ids), []
    while left:
        inside = [e for e in edges if e[0] in left and e[1] in left]
        touching = {p: [e for e in inside if p in e[:2]] for p in left}
        best = sorted(left, key=lambda p: (-len(touching[p]), -sum(e[2] for e in touching[p]), p))[0]
        members = {best}
        for a, b, _ in touching[best]:
            members |= {a, b}
        out.append((sorted(members), best))
        left = [p for p in left if p not in members]
    return out


def test_random_clusters_against_brute_force(spark):
    rng = random.Random(3)
    proposals, pairs, expected = [], [], set()
    for batch in range(40):
        ids = list(range(batch * 100 + 1, batch * 100 + 1 + rng.randint(1, 12)))
        proposals.append((batch, 0, ids, "EVENT", 0.99))
        edges = []
        for a, b in itertools.combinations(ids, 2):
            usable = rng.random() < 0.3
            confidence = rng.choice([0.95, 0.96, 0.97])
            pairs.append((batch, 0, a, b, confidence, usable))
            if usable:
                edges.append((a, b, confidence))
        expected |= {(batch, tuple(m), anchor) for m, anchor in brute_stars(ids, edges)}
    clusters = spark.createDataFrame(proposals, PROPOSALS)
    pair_frame = spark.createDataFrame(
        pairs, "batch_id bigint, cluster_no int, left_post_id bigint, right_post_id bigint, confidence double, usable boolean"
    )
    got = C.star_clusters(clusters, pair_frame).collect()
    assert {(r.batch_id, tuple(r.post_ids), r.anchor_post_id) for r in got} == expected
    # the stars of a batch partition its posts
    for batch, _, ids, _, _ in proposals:
        members = sorted(p for r in got if r.batch_id == batch for p in r.post_ids)
        assert members == ids


def test_pair_threshold(value):
    accepts = C.accepts_pair(F.col("r"), F.col("c"))
    assert value(accepts, r="SAME_EVENT", c=0.95) is True
    assert value(accepts, r="SAME_EVENT", c=0.949) is False
    assert value(accepts, r="DIFFERENT_EVENT", c=1.0) is False
    assert value(C.accepts_pair(F.lit(None).cast("string"), F.lit(None).cast("double"))) is False


CASES = [
    ([([1, 2], "EVENT", 0.9)], None),
    ([([1, 99], "EVENT", 0.9), ([2], "EVENT", 0.9)], C.UNKNOWN),
    ([([1, 2], "EVENT", 0.9), ([2], "NOISE", 0.9)], C.REPEATED),
    ([([1], "EVENT", 0.9)], C.MISSING),
    ([([1, 2], "EVENT", 2.0)], C.INVALID),
    ([([1, 2], "OTHER", 0.5)], C.INVALID),
    ([([], "EVENT", 0.5), ([1, 2], "EVENT", 0.5)], C.INVALID),
    ([([2, 2, 99], "EVENT", 0.9)], C.REPEATED),
]


def test_proposal_contract(spark):
    rows, posts = [], []
    for batch, (clusters, _) in enumerate(CASES):
        rows += [(batch, i, ids, kind, conf) for i, (ids, kind, conf) in enumerate(clusters)]
        posts += [(batch, 1), (batch, 2)]
    first = spark.createDataFrame(rows, PROPOSALS)
    batch_posts = spark.createDataFrame(posts, "batch_id bigint, post_id bigint")
    got = {r.batch_id: r.code for r in C.validate_proposals(first, batch_posts).collect()}
    assert got == {i: code for i, (_, code) in enumerate(CASES)}
    # a sound correction recovers batch 1; the other broken batches fail closed
    correction = spark.createDataFrame([(1, 0, [2, 1], "EVENT", 0.9)], PROPOSALS)
    resolved = C.resolve_proposals(first, correction, batch_posts).collect()
    modes = {r.batch_id: r.processing_mode for r in resolved}
    assert modes[0] == modes[1] == C.CLUSTERED
    assert all(modes[i] == C.FAIL_CLOSED for i in range(2, len(CASES)))
    assert [r.post_ids for r in resolved if r.batch_id == 1] == [[1, 2]]
    assert sorted(r.post_ids for r in resolved if r.batch_id == 3) == [[1], [2]]


def test_unanswered_batches_stay_pending(spark):
    first = spark.createDataFrame([(1, 0, [1], "EVENT", 0.9)], PROPOSALS)
    posts = spark.createDataFrame([(1, 1), (2, 2)], "batch_id bigint, post_id bigint")
    assert {r.batch_id for r in C.resolve_proposals(first, first.filter("false"), posts).collect()} == {1}


def decision(batch, no, ids, action, event=None, target=None, confidence=0.9, category="IRAN", fact="f"):
    return (batch, no, ids, action, event, target, confidence, fact, category, "r")


DECISION_CASES = [
    ([decision(0, 0, [1], "NEW_EVENT"), decision(0, 1, [2], "DUPLICATE", target=1)], None),
    ([decision(0, 0, [1], "MATCH_EXISTING_EVENT"), decision(0, 1, [2], "NEW_EVENT")], D.MISMATCH),
    ([decision(0, 0, [1], "MATCH_EXISTING_EVENT", event=77), decision(0, 1, [2], "NEW_EVENT")], D.UNKNOWN_EVENT),
    ([decision(0, 0, [1, 9], "NEW_EVENT"), decision(0, 1, [2], "NEW_EVENT")], D.UNKNOWN_POST),
    ([decision(0, 0, [1, 2], "NEW_EVENT"), decision(0, 1, [2], "NEW_EVENT")], D.CONTRADICTORY),
    ([decision(0, 0, [1], "NEW_EVENT")], D.MISSING),
    ([decision(0, 0, [1], "NEW_EVENT"), decision(0, 1, [2], "DUPLICATE", target=9)], D.UNKNOWN_TARGET),
    ([decision(0, 0, [1], "NOISE"), decision(0, 1, [2], "DUPLICATE", target=1)], D.BAD_TARGET),
    ([decision(0, 0, [1], "NEW_EVENT"), decision(0, 1, [2], "DUPLICATE")], D.BAD_TARGET),
    ([decision(0, 0, [1, 2], "DUPLICATE", target=1)], D.BAD_TARGET),
    ([decision(0, 0, [1, 1], "NEW_EVENT"), decision(0, 1, [2], "NEW_EVENT")], D.INVALID),
    ([decision(0, 0, [1], "NEW_EVENT", fact=""), decision(0, 1, [9], "NEW_EVENT")], D.INVALID),
    ([decision(0, 0, [1], "NEW_EVENT", category="SPORT"), decision(0, 1, [2], "NEW_EVENT")], D.INVALID),
    ([decision(0, 0, [1, 2], "NEW_EVENT"), decision(0, 1, [3], "NEW_EVENT")], D.UNEXPECTED),
]


def test_decision_contract(spark):
    rows, expected, allowed = [], [], []
    for batch, (decisions, _) in enumerate(DECISION_CASES):
        rows += [(batch, *d[1:]) for d in decisions]
        expected += [(batch, 1), (batch, 2)]
        allowed += [(batch, 1), (batch, 2), (batch, 3)]
    frame = spark.createDataFrame(rows, DECISIONS)
    wanted = spark.createDataFrame(expected, "batch_id bigint, post_id bigint")
    known = spark.createDataFrame([(0, 5)], "batch_id bigint, event_id bigint")
    verdicts = D.validate_decisions(frame, wanted, known, spark.createDataFrame(allowed, wanted.schema)).collect()
    assert {r.batch_id: r.code for r in verdicts} == {i: code for i, (_, code) in enumerate(DECISION_CASES)}
    assert {r.code for r in verdicts if r.recoverable} == set(D.RECOVERABLE)


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(101, "DUPLICATE", 102), (102, "DUPLICATE", 103), (103, "NEW_EVENT", None)], {101: 103, 102: 103}),
        ([(101, "DUPLICATE", 102), (102, "DUPLICATE", 101)], {101: None, 102: None}),
        ([(1, "DUPLICATE", 2), (2, "DUPLICATE", 3), (3, "DUPLICATE", 1), (4, "DUPLICATE", 5), (5, "NEW_EVENT", None)], {1: None, 2: None, 3: None, 4: None}),
        ([(101, "DUPLICATE", 102), (102, "NOISE", None)], {101: None}),
        ([(i, "DUPLICATE", i + 1) for i in range(1, 37)] + [(37, "NEW_EVENT", None)], {i: 37 for i in range(1, 37)}),
    ],
)
def test_duplicate_chains(spark, rows, expected):
    frame = spark.createDataFrame([decision(1, i, [p], a, target=t) for i, (p, a, t) in enumerate(rows)], DECISIONS)
    got = {r.post_id: r.target_post_id for r in D.resolve_duplicates(frame).collect()}
    assert got == expected


def test_applying_twice_changes_nothing(spark):
    from corroborate.sources.sinks import append_new, upsert_latest

    rows = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, 3, "c")], "batch_id bigint, post_id bigint, v string")
    empty = rows.filter("false")
    once = append_new(empty, rows, ["batch_id", "post_id"], ["v"])
    twice = append_new(once, rows, ["batch_id", "post_id"], ["v"])
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, 2, "a"), (1, 3, "c")]
    latest = upsert_latest(empty, rows, ["batch_id", "post_id"], ["v"])
    again = upsert_latest(latest, rows, ["batch_id", "post_id"], ["v"])
    assert sorted(latest.collect()) == sorted(again.collect()) == [(1, 2, "b"), (1, 3, "c")]


def test_exchanges_of_resolved_proposals(spark):
    """Everything is keyed by batch: what is checked and what may be kept are dealt out once each."""
    from corroborate.operators.clusters import resolve_proposals

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        answers = spark.createDataFrame(
            [(1, 0, [1, 2], "EVENT", 0.9)], "batch_id long, cluster_no long, post_ids array<long>, classification string, confidence double"
        )
        posts = spark.createDataFrame([(1, 1), (1, 2)], "batch_id long, post_id long")
        plan = resolve_proposals(answers, answers, posts)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange RoundRobin") <= 3
    assert plan.count("BroadcastExchange") <= 1


def test_posts_are_prepared_once_and_meet_in_their_cluster(spark):
    """Every pair is judged with both posts' values; a post with many pairs is prepared once and an unknown post has none."""
    posts = spark.createDataFrame([(i, None if i % 2 else f"a{i}", f"b{i}") for i in range(1, 9)], "post_id bigint, normalized_text string, original_text string")
    groups = [(1, 0, [1, 2, 3, 4]), (1, 1, [5, 6]), (2, 0, [7, 8, 99])]
    pairs = [(b, c, x, y) for b, c, ids in groups for x, y in itertools.combinations(ids, 2)]
    pairs = spark.createDataFrame(pairs, "batch_id bigint, cluster_no bigint, left_post_id bigint, right_post_id bigint")
    done = spark.sparkContext.accumulator(0)

    def count(text):
        done.add(1)
        return text.upper()

    scorer = lambda x, y: F.struct(F.concat_ws("-", x, y).alias("relationship"), F.lit(0.5).alias("confidence"))
    got = C.judgments_from(pairs, posts, scorer, prepared=F.udf(count)).collect()
    name = lambda i: f"B{i}" if i % 2 else f"A{i}"
    expected = {(b, x, y, f"{name(x)}-{name(y)}", 0.5) for b, c, ids in groups for x, y in itertools.combinations(ids, 2) if y != 99}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert done.value == 8
