"""Daily quotas, the cost ledger and the publication limiter."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.config import LIMITS
from corroborate.functions.timefn import day_key
from corroborate.operators.blocks import (
    join_null_safe,
    number_rows,
    previous_value,
    running_sum,
    time_block,
    top_per_key,
    trailing_counts,
)
from corroborate.session import cut_lineage

CALL_ORDER = ["ts", "call_id"]


def admit_calls(calls: DataFrame, caps: Column) -> DataFrame:
    """The first calls of every (day, stage) are reserved, the rest blocked.

    Positions come from minute blocks, so a stage that takes most of the log
    is spread over its minutes.
    """
    placed = number_rows(calls, ["day", "stage"], CALL_ORDER, time_block(F.col("ts")), "position")
    cap = F.coalesce(caps, F.lit(0))
    return placed.withColumn("admitted", (cap > 0) & (F.col("position") <= cap))


def admit_costs(calls: DataFrame, cost: int, budget: int, caps: Column) -> DataFrame:
    """Stage caps plus one cost ledger per day, for calls of equal cost.

    A call counts against its stage and the ledger only when admitted. With
    one cost the ledger is full for good once it is full, so a call passes iff
    its position in its stage is within the cap and its position among the
    calls that pass their stage is within ``budget / cost``.
    """
    if cost <= 0 or cost > budget:
        return calls.withColumn("admitted", F.lit(False))
    staged = admit_calls(calls, caps).withColumnRenamed("admitted", "_in_stage").drop("position")
    passed = F.col("_in_stage").cast("bigint")
    ranked = running_sum(staged, ["day"], CALL_ORDER, time_block(F.col("ts")), passed, "_rank")
    return ranked.withColumn("admitted", F.col("_in_stage") & (F.col("_rank") <= budget // cost)).drop("_in_stage", "_rank")


def admit_mixed_costs(calls: DataFrame, budget: int, caps: Column) -> DataFrame:
    """Stage caps plus one cost ledger per day, for calls of any costs.

    In time order a call passes if its stage has room and its ``cost`` fits
    into what is left of the day's budget; only then it counts against both.
    What is left only falls and a stage only fills. So the first call that
    does not pass, if all before it do, settles more: a full stage stays full,
    and no later call of a cost above what is left passes. Each round takes the
    calls before that point as admitted and drops what is settled, and goes on
    with the rest; a day needs at most as many rounds as it has stages and
    different costs. A round is two running sums in time blocks, over
    the calls that are still open. Null and non-positive costs, costs above
    the budget and null caps are never admitted. ``call_id`` is unique.
    """
    cost, cap = F.col("cost"), F.coalesce(caps, F.lit(0)).cast("bigint")
    able = F.coalesce((cost > 0) & (cost <= budget), F.lit(False)) & (cap > 0)
    slim = calls.select("day", "stage", "ts", "call_id", cost.cast("bigint").alias("cost"), cap.alias("_cap"))
    open_ = cut_lineage(slim.filter(able))
    spent = open_.select("day", "stage", F.lit(0).cast("bigint").alias("_calls"), F.lit(0).cast("bigint").alias("_spent")).distinct()
    admitted = None
    while not open_.isEmpty():
        used = cut_lineage(spent)
        by_day = used.groupBy("day").agg(F.sum("_spent").alias("_day_spent"))
        summed = running_sum(open_, ["day"], CALL_ORDER, time_block(F.col("ts")), F.col("cost"), "_sum")
        placed = number_rows(summed, ["day", "stage"], CALL_ORDER, time_block(F.col("ts")), "_position")
        known = join_null_safe(join_null_safe(placed, by_day, ["day"]), used.select("day", "stage", "_calls"), ["day", "stage"])
        state = known.withColumn("_full", F.col("_position") + F.col("_calls") > F.col("_cap"))
        state = cut_lineage(state.withColumn("_left", budget - F.col("_day_spent") - F.col("_sum") + F.col("cost")))
        stop = F.struct("ts", "call_id", "_full", "stage", "_left")
        failed = F.col("_full") | (F.col("cost") > F.col("_left"))
        stops = state.filter(failed).groupBy("day").agg(F.min(stop).alias("_stop"))
        settled = join_null_safe(state, stops, ["day"], "left")
        before = F.col("_stop").isNull() | (F.struct("ts", "call_id") < F.struct("_stop.ts", "_stop.call_id"))
        taken = cut_lineage(settled.filter(before).select("day", "stage", "call_id", "cost"))
        admitted = taken if admitted is None else admitted.unionByName(taken)
        gone = F.when(F.col("_stop._full"), F.col("stage").eqNullSafe(F.col("_stop.stage"))).otherwise(F.col("cost") > F.col("_stop._left"))
        open_ = cut_lineage(settled.filter(~before & ~gone).select(*slim.columns))
        now_used = taken.groupBy("day", "stage").agg(F.count("*").alias("_calls"), F.sum("cost").alias("_spent"))
        spent = used.unionByName(now_used).groupBy("day", "stage").agg(F.sum("_calls").alias("_calls"), F.sum("_spent").alias("_spent"))
    if admitted is None:
        return calls.withColumn("admitted", F.lit(False))
    passed = admitted.select(F.col("call_id").alias("_id"))
    return calls.join(passed, F.col("call_id") == F.col("_id"), "left").withColumn("admitted", F.col("_id").isNotNull()).drop("_id")


def backfill_budget(usage: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger raised to the sum of the stages of each day."""
    summed = usage.groupBy("usage_date").agg(
        F.sum("cost").alias("_sum"), F.max("updated_at").alias("_touched")
    )
    return ledger.join(summed, "usage_date", "full_outer").select(
        "usage_date",
        F.greatest("cost", "_sum").alias("cost"),
        F.coalesce("_touched", "updated_at").alias("updated_at"),
    )


def activity_time() -> Column:
    """Latest of publication and update; failed attempts count by their update."""
    return F.greatest("published_at", "updated_at")


def publication_rates(stories: DataFrame, start: Column, now: Column) -> DataFrame:
    """Publications since ``start``, in the last hour and in this cycle."""
    width = LIMITS.window_minutes * 60
    cycle = F.timestamp_seconds(F.floor(F.unix_seconds(now) / width) * width)
    at = F.col("_at")
    return (
        stories.withColumn("_at", activity_time())
        .filter(at >= start)
        .agg(
            F.count("*").alias("total"),
            F.count_if(at >= now - F.expr("interval 1 hour")).alias("hourly"),
            F.count_if((at >= cycle) & (at < cycle + F.expr(f"interval {LIMITS.window_minutes} minutes"))).alias("cycle"),
        )
    )


def limiter_reason(total: Column, hourly: Column, cycle: Column, limits=LIMITS) -> Column:
    """E5: which limit blocks a publication: total, then hour, then cycle."""
    return (
        F.when(total >= limits.publish_total, F.lit("canary_total_exhausted"))
        .when(hourly >= limits.publish_per_hour, F.lit("canary_hour_exhausted"))
        .when(cycle >= limits.publish_per_cycle, F.lit("canary_cycle_exhausted"))
        .otherwise(F.lit("allowed"))
    )


def limiter_decision(stories: DataFrame, start: Column, now: Column, limits=LIMITS, enabled: bool = True) -> DataFrame:
    """E5: the limiter's answer at ``now``.

    Switched off it allows everything; without a start, or with a limit that
    is no positive whole number, it allows nothing. Counts are 0 in both.
    """
    counts = publication_rates(stories, start, now)
    caps = (limits.publish_per_cycle, limits.publish_per_hour, limits.publish_total)
    valid = F.lit(all(isinstance(c, int) and c > 0 for c in caps)) & start.isNotNull()
    reason = limiter_reason(F.col("total"), F.col("hourly"), F.col("cycle"), limits)
    if not enabled:
        reason, valid = F.lit("canary_disabled"), F.lit(False)
    else:
        reason = F.when(valid, reason).otherwise(F.lit("canary_configuration_invalid"))
    return counts.select(
        *(F.when(valid, F.col(c)).otherwise(F.lit(0)).alias(c) for c in counts.columns), reason.alias("reason")
    ).withColumn("allowed", F.col("reason").isin("allowed", "canary_disabled"))


def replay_limiter(stories: DataFrame, start: Column, limits=LIMITS) -> DataFrame:
    """E5 over a whole log: counts and the limiter's answer right after each row.

    Total, trailing hour and cycle are running counts over distinct instants.
    """
    log = stories.withColumn("_at", activity_time()).filter(F.col("_at") >= start)
    counts = trailing_counts(log, "_at", 3_600)
    width = LIMITS.window_minutes * 60 * 1_000_000
    counts = counts.withColumn("_cycle", F.floor(F.col("micros") / width))
    counts = running_sum(
        counts, ["_cycle"], ["micros"], F.floor(F.col("micros") / 60_000_000), F.col("n"), "cycle"
    ).select("micros", F.col("running").alias("total"), F.col("trailing").alias("hourly"), "cycle")
    return (
        log.withColumn("micros", F.unix_micros("_at"))
        .join(counts, "micros")
        .withColumn("reason", limiter_reason(F.col("total"), F.col("hourly"), F.col("cycle"), limits))
        .drop("_at", "micros")
    )


def admit_publications(
    candidates: DataFrame, start: Column, limits=LIMITS, enabled: bool = True, channel: str = "channel"
) -> DataFrame:
    """E5: the limiter run over a log of candidates (channel, at, candidate_id): counts, ``reason`` and ``allowed`` of each.

    In time order a candidate is published if, of those published since
    ``start``, fewer than the limits lie in all, in the hour up to it (both
    ends included) and in its five-minute cycle; only published ones count.
    Candidates before ``start`` are not looked at and get ``before_start``.
    Switched off the limiter allows all; without a start, or with a limit that
    is no positive whole number, nothing.

    Where a channel is silent for more than an hour, both the hour and the
    cycle are empty. Channels are cut there and the pieces folded apart: a
    piece's rows stream through one task in order, which holds the times of
    at most ``publish_per_hour`` publications, however long the piece is. The
    total needs no fold: it blocks all from one point on, which a running
    count of what the fold admits gives.
    """
    caps = (limits.publish_per_cycle, limits.publish_per_hour, limits.publish_total)
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("total", "hourly", "cycle")]
    if not enabled or not all(isinstance(c, int) and c > 0 for c in caps):
        reason = "canary_configuration_invalid" if enabled else "canary_disabled"
        return candidates.select("*", *zero, F.lit(reason).alias("reason"), F.lit(not enabled).alias("allowed"))
    order = ["at", "candidate_id"]
    log = candidates.select(F.col(channel).alias("channel"), "at", "candidate_id").filter(F.col("at") >= start)
    before = previous_value(log, ["channel"], order, time_block(F.col("at")), F.col("at"), "_earlier")
    opens = (F.col("_earlier").isNull() | (F.unix_micros("at") - F.unix_micros("_earlier") > 3_600_000_000)).cast("bigint")
    pieces = running_sum(before, ["channel"], order, time_block(F.col("at")), opens, "piece")
    slim = pieces.select("channel", "piece", F.unix_micros("at").alias("micros"), "candidate_id")
    dealt = slim.repartition("channel", "piece").sortWithinPartitions("channel", "piece", "micros", "candidate_id")
    per_cycle, per_hour = limits.publish_per_cycle, limits.publish_per_hour
    width = LIMITS.window_minutes * 60 * 1_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, hour, cycle, in_cycle = None, deque(), None, 0
        for batch in batches:
            hourly, cycled, passed = [], [], []
            for *key, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key != piece:
                    piece, cycle = key, None
                    hour.clear()
                while hour and hour[0] < at - 3_600_000_000:
                    hour.popleft()
                if at // width != cycle:
                    cycle, in_cycle = at // width, 0
                hourly.append(len(hour))
                cycled.append(in_cycle)
                passed.append(len(hour) < per_hour and in_cycle < per_cycle)
                if passed[-1]:
                    hour.append(at)
                    in_cycle += 1
            new = [pa.array(hourly, pa.int64()), pa.array(cycled, pa.int64()), pa.array(passed, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "hourly", "cycle", "passed"])

    kinds = dict(slim.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in slim.columns)
    folded = cut_lineage(dealt.mapInArrow(fold, f"{schema}, hourly bigint, cycle bigint, passed boolean"))
    block = F.floor(F.col("micros") / 60_000_000)
    counted = running_sum(folded, ["channel"], ["micros", "candidate_id"], block, F.col("passed").cast("bigint"), "_upto")
    total = F.col("_upto") - F.col("passed").cast("bigint")
    spent = total >= limits.publish_total
    # Once the total is reached the hour and the cycle run empty; no hour holds more than its limit of publications.
    last = F.col("passed") & F.col("_upto").between(limits.publish_total - per_hour + 1, limits.publish_total)
    recent = counted.filter(last).groupBy("channel").agg(F.collect_list("micros").alias("_recent"))
    counted = join_null_safe(counted.withColumn("_total", total), recent, ["channel"], "left")

    def still(since: Column) -> Column:
        return F.coalesce(F.size(F.filter("_recent", lambda t: t >= since)), F.lit(0))

    micros = F.col("micros")
    hourly = F.when(spent, still(micros - 3_600_000_000)).otherwise(F.col("hourly")).cast("bigint")
    cycle = F.when(spent, still(micros - micros % width)).otherwise(F.col("cycle")).cast("bigint")
    total = F.least(total, F.lit(limits.publish_total)).cast("bigint")
    answers = counted.select(F.col("candidate_id").alias("_id"), total.alias("total"), hourly.alias("hourly"), cycle.alias("cycle"))
    answers = answers.withColumn("reason", limiter_reason(F.col("total"), F.col("hourly"), F.col("cycle"), limits))
    named = candidates.join(answers, F.col("candidate_id") == F.col("_id"), "left").drop("_id")
    invalid = F.when(start.isNull(), F.lit("canary_configuration_invalid")).otherwise(F.lit("before_start"))
    return named.withColumn("reason", F.coalesce("reason", invalid)).withColumn("allowed", F.col("reason") == "allowed")


def usage_signal(calls: Column) -> Column:
    """How close a daily usage is to its cap."""
    return F.when(calls >= LIMITS.usage_critical, F.lit("CRITICAL")).when(calls >= LIMITS.usage_high, F.lit("HIGH"))


def reservation_stats(events: DataFrame, keep: int = LIMITS.telemetry_entries) -> DataFrame:
    """Reservation counters per batch; ``reservation_entries`` has the first ``keep`` entries themselves."""
    return (
        events.groupBy("batch_id")
        .agg(
            F.count("*").alias("attempts"),
            F.count_if(F.col("reservation") == "RESERVED").alias("reserved"),
            F.count_if(F.col("reservation") != "RESERVED").alias("blocked"),
            F.count_if("retry").alias("retries"),
        )
        .withColumn("truncated", F.greatest(F.lit(0).cast("bigint"), F.col("attempts") - keep))
        .withColumn("usage_signal", usage_signal(F.col("reserved")))
    )


def reservation_entries(events: DataFrame, order: list, keep: int = LIMITS.telemetry_entries) -> DataFrame:
    """The first ``keep`` reservation entries of every batch, with their place."""
    return top_per_key(events, ["batch_id"], order, keep, "entry_no")


def usage_by_stage(calls: DataFrame) -> DataFrame:
    """Admitted calls and their cost per day and stage."""
    return calls.groupBy("day", "stage").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))


def stories_on(stories: DataFrame, day: str) -> DataFrame:
    """Stories published on a day."""
    hit = (F.col("publication_state") == "published") & (day_key(F.col("published_at")) == day)
    return stories.agg(F.count_if(hit).alias("stories"))
