"""The scored shortlist against scores of every window and event."""

import datetime as dt
import random

import pytest

from corroborate.operators import shortlist as L

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("cap, common, least", [(3, 130, 4), (5, 12, 2), (10, 252, 1000), (2, 3, 1)])
def test_scored_events_one_by_one(spark, cap, common, least):
    rng = random.Random(cap)
    words = [f"word{i}" for i in range(140)]

    def text(n, rare):
        some = [words[min(int(rng.paretovariate(0.5)) - 1, 139)] for _ in range(n)]
        return " ".join(some + [rng.choice(["war", "oil", "the", f"odd{rng.randrange(300)}"]) for _ in range(rare)])

    reports = [(T0 + dt.timedelta(minutes=5 * rng.randrange(1200)), text(rng.randint(0, 25), rng.randint(0, 2))) for _ in range(50)]
    events = []
    for i in range(160):
        first = T0 + dt.timedelta(minutes=rng.randrange(6000))
        last = first + dt.timedelta(minutes=rng.choice([0, 7, 3000]))
        events.append((i, text(rng.randint(0, 20), rng.randint(0, 2)), rng.choice(["WAR_SECURITY", "ECONOMY", "IRAN", None]), first, last))
    got = L.scored_events(
        spark.createDataFrame(reports, "window_end timestamp, text string"),
        spark.createDataFrame(events, "event_id bigint, text string, category string, first_seen_at timestamp, last_updated_at timestamp"),
        cap, common, least,
    ).collect()

    def kept(t):
        return {w for w in t.split() if len(w) >= 3 and w != "the"}

    vocabulary, hints = {}, {}
    for end, t in reports:
        vocabulary.setdefault(end, set()).update(kept(t))
        hints.setdefault(end, set()).update({c for w, c in (("war", "WAR_SECURITY"), ("oil", "ECONOMY")) if w in t})
    expected = set()
    for end, own in vocabulary.items():
        rows = []
        for i, t, category, first, last in events:
            if first <= end and last >= end - dt.timedelta(hours=48):
                shared = len(own & kept(t))
                age = max(0.0, (end - last).total_seconds() / 3600)
                rows.append((shared * 10 + (4 if category in hints[end] else 0) + 1 / (1 + age / 24), last, i, shared))
        for rank, (_, _, i, shared) in enumerate(sorted(rows, reverse=True)[:cap], 1):
            expected.add((end, i, shared, rank))
    assert {(r.window_end, r.event_id, r.shared, r.event_rank) for r in got} == expected and len(got) == len(expected)


def test_few_pairs_are_scored(spark, monkeypatch):
    """Windows and events of all times share words here and there; only pairs that may be among the best are scored."""
    rng = random.Random(7)
    reports, events = [], []
    for i in range(40):
        end = T0 + dt.timedelta(hours=12 * i)
        own = [f"own{i}x{k}" for k in range(12)]
        reports.append((end, " ".join(own + [f"some{k}" for k in range(60)])))
        for k in range(5):
            some = rng.sample([f"some{n}" for n in range(60)], 6)
            events.append((10 * i + k, " ".join(own + some if k < 3 else some), "IRAN", end - dt.timedelta(minutes=k), end))
    scored = []
    plain = L._scores
    monkeypatch.setattr(L, "_scores", lambda pairs, *rest: scored.append(pairs.count()) or plain(pairs, *rest))
    got = L.scored_events(
        spark.createDataFrame(reports, "window_end timestamp, text string"),
        spark.createDataFrame(events, "event_id bigint, text string, category string, first_seen_at timestamp, last_updated_at timestamp"), 2,
    ).collect()
    assert {(r.shared, r.event_id % 10 < 3) for r in got} == {(18, True)} and len(got) == 80
    assert sum(scored) < 40 * 15  # 25 events are in reach of most windows and share words with them


@pytest.mark.parametrize("block_events", [3, 40])
def test_blocks_of_a_day_give_the_same_shortlist(spark, block_events):
    """The best of a day are the best of its blocks, whether or not windows and events have words, hints or a category."""
    rng = random.Random(5)

    def text():
        return None if rng.random() < 0.1 else " ".join(rng.choice(["war", "oil", "", *(f"word{i}" for i in range(9))]) for _ in range(rng.randint(0, 300)))

    reports = [(T0 + dt.timedelta(minutes=5 * rng.randrange(900)), text()) for _ in range(60)] + [(None, "word1")]
    events = [(i, text(), rng.choice(["WAR_SECURITY", None]), T0 + dt.timedelta(hours=rng.randrange(80)), T0 + dt.timedelta(hours=rng.randrange(40, 90))) for i in range(60)]
    events.append((60, "word1 word2", "WAR_SECURITY", T0, None))
    frames = [
        spark.createDataFrame(reports, "window_end timestamp, text string"),
        spark.createDataFrame(events, "event_id bigint, text string, category string, first_seen_at timestamp, last_updated_at timestamp"),
    ]
    got = [L.scored_events(*frames, 4, **options).collect() for options in ({}, {"block_events": block_events})]
    assert set(got[0]) == set(got[1]) and len(got[0]) == len(got[1])
    reach = {w: sum(f <= w and u is not None and u >= w - dt.timedelta(hours=48) for _, _, _, f, u in events) for w, _ in reports if w}
    assert len(got[0]) == sum(min(4, n) for n in reach.values())
