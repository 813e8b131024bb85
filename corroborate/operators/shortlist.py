"""Which known events are in reach of a batch window."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.config import LIMITS
from corroborate.functions.text import NOT_WORD, STOP_WORDS, category_hints
from corroborate.operators.blocks import running_sum, top_per_key
from corroborate.session import cut_lineage, stored

SLOT_SECONDS = LIMITS.window_minutes * 60
HOUR_SLOTS = 3_600 // SLOT_SECONDS
DAY_SLOTS = 86_400 // SLOT_SECONDS
HORIZON = LIMITS.event_horizon_hours * 3_600
#: Defaults of two parameters of ``scored_events`` that have no effect any more.
COMMON_TOKENS = 252
LEAST_COMMON = 1_000
#: Events of a day that are scored in one task, and those whose words are added up at once.
BLOCK_EVENTS = 4_096
EVENTS_AT_ONCE = 256
#: Words of 64 bits for the windows of a day.
SLOT_LONGS = -(-DAY_SLOTS // 64)
_WORD, _HINT, _WINDOW = range(3)
DAY_SECONDS = 86_400


def eligible_event_counts(windows: DataFrame, events: DataFrame) -> DataFrame:
    """Events per window with first_seen <= end and last_updated >= end - 48 h.

    Every event is +1 when it is first seen and -1 just after it falls out of
    the horizon; a window reads the running sum. Equal marks are added up
    first and the sum runs in minute blocks, so the cost is linear in both
    tables and no (window, event) pair is ever built.
    """
    horizon = HORIZON * 1_000_000
    seen, last = F.unix_micros("first_seen_at"), F.unix_micros("last_updated_at")
    live = events.filter(seen <= last + horizon)
    one = F.lit(1).cast("bigint")
    marks = (
        live.select(seen.alias("at"), F.lit(0).alias("kind"), one.alias("value"))
        .unionByName(live.select((last + horizon).alias("at"), F.lit(2).alias("kind"), (-one).alias("value")))
        .groupBy("at", "kind")
        .agg(F.sum("value").alias("value"))
    )
    probes = windows.select(
        F.unix_micros("window_end").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("value")
    ).distinct()
    summed = running_sum(
        marks.unionByName(probes), [], ["at", "kind"], F.floor(F.col("at") / 60_000_000), F.col("value"), "active_events"
    )
    return summed.filter("kind = 1").select(F.timestamp_micros("at").alias("window_end"), "active_events")


def _range(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def _nodes(first: Column, last: Column) -> Column:
    """Cover the slots ``first..last`` by whole days, whole hours and single slots.

    An interval of two days or more always holds a whole day, so what is left
    on either side is shorter than a day: at most 23 hours and 11 slots.
    """
    day_low, day_high = F.ceil(first / DAY_SLOTS), F.floor((last + 1) / DAY_SLOTS) - 1
    left_end, right_start = day_low * DAY_SLOTS - 1, (day_high + 1) * DAY_SLOTS
    left_hour = F.ceil(first / HOUR_SLOTS)
    right_hour = F.floor((last + 1) / HOUR_SLOTS) - 1

    def level(name: str, indexes: Column) -> Column:
        return F.transform(indexes, lambda i: F.struct(F.lit(name).alias("level"), i.alias("index")))

    return F.concat(
        level("day", _range(day_low, day_high)),
        level("hour", _range(left_hour, F.floor((left_end + 1) / HOUR_SLOTS) - 1)),
        level("slot", _range(first, left_hour * HOUR_SLOTS - 1)),
        level("hour", _range(F.floor(right_start / HOUR_SLOTS), right_hour)),
        level("slot", _range((right_hour + 1) * HOUR_SLOTS, last)),
    )


def _lookups(window_end: Column) -> Column:
    """The day, hour and slot nodes that hold the events in reach of a window."""
    slot = F.floor(F.unix_seconds(window_end) / SLOT_SECONDS)
    return F.array(
        F.struct(F.lit("day").alias("level"), F.floor(slot / DAY_SLOTS).alias("index")),
        F.struct(F.lit("hour").alias("level"), F.floor(slot / HOUR_SLOTS).alias("index")),
        F.struct(F.lit("slot").alias("level"), slot.alias("index")),
    )


def _placed(events: DataFrame, *columns: str) -> DataFrame:
    """Events at the nodes that cover the slots they are in reach of; each slot is under exactly one of them."""
    first = F.ceil(F.unix_micros("first_seen_at") / (SLOT_SECONDS * 1_000_000))
    last = F.floor((F.unix_micros("last_updated_at") + HORIZON * 1_000_000) / (SLOT_SECONDS * 1_000_000))
    spans = events.select(*columns, first.alias("_first"), last.alias("_last")).filter("_first <= _last")
    placed = spans.select(*columns, F.explode(_nodes(F.col("_first"), F.col("_last"))).alias("_node"))
    return placed.select("_node.level", "_node.index", *columns)


def newest_events(windows: DataFrame, events: DataFrame, cap: int = LIMITS.active_events) -> DataFrame:
    """the ``cap`` most recently updated events in reach of each window.

    The slots an event is in reach of are covered by day, hour and slot nodes.
    Among the events of one node only the newest ``cap`` can be in the answer
    of any of its windows, so every node is cut to ``cap`` before the shuffle
    (map-side group limit) and a window then meets at most 3 x cap rows.
    """
    if cap < LIMITS.active_events:
        raise ValueError(f"a shortlist of fewer than {LIMITS.active_events} events needs scores: use scored_events")
    order = [F.col("last_updated_at").desc(), F.col("event_id").desc()]
    placed = _placed(events, "event_id", "last_updated_at")
    pruned = top_per_key(placed, ["level", "index"], order, cap).drop("_rank")
    probes = windows.select("window_end").distinct().select("window_end", F.explode(_lookups(F.col("window_end"))).alias("_node"))
    found = probes.select("window_end", "_node.level", "_node.index").join(pruned, ["level", "index"])
    return top_per_key(found.drop("level", "index"), ["window_end"], order, cap, "event_rank")


def vocabulary(text: Column) -> Column:
    """Distinct lower-case words of three letters or digits and more, without stop words."""
    words = F.filter(F.split(F.lower(text), NOT_WORD), lambda w: F.char_length(w) >= 3)
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def scored_events(
    reports: DataFrame, events: DataFrame, cap: int, common_tokens: int = COMMON_TOKENS, least_common: int = LEAST_COMMON,
    block_events: int = BLOCK_EVENTS,
) -> DataFrame:
    """the ``cap`` best events in reach of each window, by 10 x shared words, category hint (4) and recency (1 at most).

    ``reports`` has window_end and text, ``events`` event_id, text, category
    and the two times. Equal scores go to the later update, then the larger id.

    A day has 288 windows, so an event meets at most 576 and those of its own
    duration, and the shared words of all pairs in reach can be counted in time
    that grows with the events. Each day has one row for each word, with its
    windows as bits; the day's events are dealt out in blocks of
    ``block_events``, and a block adds up the bits of each event's words. Only
    the ``cap`` best of each window and block leave their task.
    ``common_tokens`` and ``least_common`` have no effect any more: no word is treated in a way of its own.
    """
    slot = F.floor(F.unix_seconds("window_end") / SLOT_SECONDS)
    words, hints = vocabulary(F.col("text")), category_hints(F.col("text"))

    def marks(kind: int, names: Column) -> Column:
        return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name")))

    # The empty name of kind _WINDOW stands for the window itself, which may have no words.
    found = reports.filter("window_end is not null").select(slot.alias("slot"), F.explode(F.concat(marks(_WORD, words), marks(_HINT, hints), marks(_WINDOW, F.array(F.lit(""))))).alias("m"))
    found = found.select(F.floor(F.col("slot") / DAY_SLOTS).alias("day"), F.pmod("slot", F.lit(DAY_SLOTS)).cast("int").alias("at"), "m.kind", "m.name")
    flags = [F.bit_or(F.when(F.floor(F.col("at") / 64) == k, F.expr("shiftleft(1L, at % 64)")).otherwise(F.lit(0).cast("bigint"))).alias(f"bits{k}") for k in range(SLOT_LONGS)]
    found = stored(found.groupBy("day", "kind", "name").agg(*flags))
    first, last = F.unix_micros("first_seen_at"), F.unix_micros("last_updated_at")
    days = _range(F.floor(first / (DAY_SECONDS * 1_000_000)), F.floor((last + HORIZON * 1_000_000) / (DAY_SECONDS * 1_000_000)))
    placed = events.select("event_id", "category", first.alias("first"), last.alias("last"), F.explode(days).alias("day"))
    blocks = placed.groupBy("day").agg(F.ceil(F.count("*") / block_events).cast("int").alias("blocks"))
    blocks = cut_lineage(blocks.join(found.filter(F.col("kind") == _WINDOW).select("day"), "day"))
    about = events.select("event_id", F.coalesce(vocabulary(F.col("text")), F.array().cast("array<string>")).alias("words"), "category", first.alias("first"), last.alias("last"), days.alias("_days"))
    about = about.select("*", F.explode("_days").alias("day")).drop("_days").join(blocks, "day")
    about = about.withColumn("block", F.pmod(F.xxhash64("event_id"), F.col("blocks")).cast("int")).drop("blocks")
    sent = found.join(blocks, "day").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    best = sent.groupBy("day", "block").cogroup(about.groupBy("day", "block")).applyInArrow(
        partial(_best_of_block, cap), f"window_end bigint, event_id {dict(events.dtypes)['event_id']}, last_updated_at bigint, shared bigint, hinted boolean"
    )
    instants = {c: F.timestamp_micros(c) for c in ("window_end", "last_updated_at")}
    order = [F.col("score").desc(), F.col("last_updated_at").desc(), F.col("event_id").desc()]
    scored = _scores(best.withColumns(instants))
    return top_per_key(scored, ["window_end"], order, cap, "event_rank").select("window_end", "event_id", "shared", "score", "event_rank")


def _scores(pairs: DataFrame) -> DataFrame:
    """Scores of pairs (window_end, event_id, last_updated_at, shared, hinted)."""
    boost = F.when(F.col("hinted"), F.lit(4)).otherwise(F.lit(0))
    age = F.greatest(F.lit(0.0), (F.unix_micros("window_end") - F.unix_micros("last_updated_at")) / F.lit(3_600_000_000.0))
    score = F.col("shared") * 10 + boost + F.lit(1.0) / (F.lit(1.0) + age / F.lit(24.0))
    return pairs.select("window_end", "event_id", "last_updated_at", "shared", score.alias("score"))


def _whole(column) -> pa.Array:
    """One array of a table's column."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _best_of_block(cap: int, found: pa.Table, events: pa.Table) -> pa.Table:
    """The ``cap`` best of a block of a day's events for each window of the day, from the bits of words and hints."""
    events = events.sort_by([("last", "descending"), ("event_id", "descending")])  # stable sorts keep this order
    bits = np.column_stack([found.column(f"bits{k}").to_numpy() for k in range(SLOT_LONGS)]).astype("<i8")
    kind = found.column("kind").to_numpy()
    names = _whole(found.column("name"))

    def windows_of(rows: np.ndarray) -> np.ndarray:
        return np.unpackbits(np.ascontiguousarray(bits[rows]).view("uint8"), axis=1, bitorder="little")

    def code(values: pa.Array, rows: np.ndarray) -> np.ndarray:
        """Where values stand among the names of some rows; -1 for those that are not there."""
        places = pc.index_in(values, value_set=names.take(pa.array(rows)), skip_nulls=True)
        return pc.fill_null(places, -1).to_numpy(zero_copy_only=False)

    slots = np.flatnonzero(windows_of(np.flatnonzero(kind == _WINDOW)).any(axis=0))
    day = found.column("day")[0].as_py() if len(found) else 0
    ends = (day * DAY_SLOTS + slots) * (SLOT_SECONDS * 1_000_000)
    first, last = events.column("first").to_numpy(), events.column("last").to_numpy()
    shared = np.zeros((len(events), len(slots)), np.int64)
    rows = np.flatnonzero(kind == _WORD)
    lists = _whole(events.column("words"))
    bounds = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)
    word = code(lists.flatten(), rows)
    used, place = np.unique(word[word >= 0], return_inverse=True)
    held = windows_of(rows[used])[:, slots]
    owner = np.repeat(np.arange(len(events)), np.diff(bounds))[word >= 0]
    edges = np.searchsorted(owner, np.arange(len(events) + 1))
    for a in range(0, len(events), EVENTS_AT_ONCE):
        some = np.arange(a, min(a + EVENTS_AT_ONCE, len(events)))
        some = some[edges[some] < edges[some + 1]]
        if len(some):
            part = held[place[edges[some[0]] : edges[some[-1] + 1]]]
            shared[some] = np.add.reduceat(part, edges[some] - edges[some[0]], axis=0, dtype=np.int32)
    rows = np.flatnonzero(kind == _HINT)
    category = code(_whole(events.column("category")), rows)
    hinted = np.vstack([windows_of(rows)[:, slots], np.zeros((1, len(slots)), "uint8")])[category].astype(bool)
    age = np.maximum(0.0, (ends[None, :] - last[:, None]) / 3_600_000_000.0)
    score = (shared * 10 + np.where(hinted, 4, 0)) + 1.0 / (1.0 + age / 24.0)
    score[(first[:, None] > ends) | (last[:, None] < ends - HORIZON * 1_000_000)] = -np.inf
    best = np.argsort(-score, axis=0, kind="stable")[:cap]
    window = np.broadcast_to(np.arange(len(slots)), best.shape)
    kept = score[best, window] > -np.inf
    event, window = best[kept], window[kept]
    return pa.table(
        {
            "window_end": pa.array(ends[window]),
            "event_id": _whole(events.column("event_id")).take(pa.array(event)),
            "last_updated_at": pa.array(last[event]),
            "shared": pa.array(shared[event, window]),
            "hinted": pa.array(hinted[event, window]),
        }
    )
