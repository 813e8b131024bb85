"""Batches: claim order, prefix packing, full packing of windows, sampling groups."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.config import LIMITS
from corroborate.functions.text import compact_report
from corroborate.functions.timefn import window_end, window_start
from corroborate.operators.blocks import id_block, join_few, number_rows, running_sum, time_block
from corroborate.operators.posts import arrived_at, eligible
from corroborate.session import cut_lineage

ROW_OVERHEAD = 32
ARRAY_RESERVE = 10_000


def claim_order(posts: DataFrame, now: Column, limit: int = max(LIMITS.reports_per_batch * 4, 40)) -> DataFrame:
    """Fresh posts first, then the backlog, each oldest first.

    A limited sort: every task keeps its own first rows only.
    """
    fresh = arrived_at() >= now - F.expr(f"interval {LIMITS.fresh_minutes} minutes")
    return (
        eligible(posts)
        .withColumn("is_fresh", fresh)
        .orderBy(F.col("is_fresh").desc(), arrived_at(), "post_id")
        .limit(limit)
    )


def report_json() -> Column:
    """The compact report of the current row; instants as ISO text."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    return compact_report(
        F.col("post_id"),
        F.col("source_id"),
        F.col("source_name"),
        F.date_format("published_at", stamp),
        F.date_format("observed_at", stamp),
        F.col("normalized_text"),
        F.col("original_text"),
    )


def payload_budget(prompt_chars: int, payload_chars: int = LIMITS.payload_chars) -> int:
    return max(4_000, payload_chars - prompt_chars - 1_000)


def pack_batch(candidates: DataFrame, budget: int, max_rows: int = LIMITS.reports_per_batch) -> DataFrame:
    """The longest prefix of the claim order that fits a batch.

    ``candidates`` is the limited output of :func:`claim_order` joined with
    source names, so the window runs over at most that many rows. Sizes are
    positive, so the prefix ends at the first overflow.
    """
    order = Window.orderBy(F.col("is_fresh").desc(), arrived_at(), "post_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        candidates.withColumn("size", F.char_length(report_json()) + ROW_OVERHEAD)
        .withColumn("position", F.row_number().over(order))
        .withColumn("cumulative", F.sum("size").over(upto))
        .filter((F.col("position") <= max_rows) & ((F.col("position") == 1) | (F.col("cumulative") <= budget)))
    )


def _next_starts(sizes, max_rows: int, max_chars: int) -> list[int]:
    """For every position, where the batch that starts there ends."""
    rows, ends, end, total = len(sizes), [], 0, 0
    for start in range(rows):
        if end < start:
            end, total = start, 0
        while end < rows and end - start < max_rows and (end == start or 2 + total + sizes[end] + (end - start) <= max_chars):
            total += sizes[end]
            end += 1
        ends.append(end)
        total -= sizes[start]
    return ends


def _block_exits(max_rows, max_chars, block_rows, frames):
    """Where each possible entry of a block leaves it, counted from its end."""
    for frame in frames:
        out = []
        for sizes in frame["_sizes"]:
            own = min(block_rows, len(sizes))
            ends = _next_starts(list(sizes), max_rows, max_chars)
            exits = []
            for entry in range(min(max_rows, own)):
                at = entry
                while at < own:
                    at = ends[at]
                exits.append(at - own)
            out.append(exits)
        yield frame[["window_end", "_block"]].assign(_exits=out)


def _chain_blocks(frame):
    """The entry that occurs at each block of one window."""
    ordered = frame.sort_values("_block")
    entries, entry = [], 0
    for exits in ordered["_exits"]:
        entries.append(entry)
        entry = int(exits[entry]) if entry < len(exits) else 0
    return ordered[["window_end", "_block"]].assign(_entry=entries).astype({"_entry": "int32"})


def _batch_starts(sizes: Column, entry: Column, own: Column, max_rows: int, max_chars: int) -> Column:
    """Positions of the batch starts of a block that is entered at ``entry``."""
    start = F.struct(
        F.lit(0).cast("bigint").alias("chars"), F.lit(0).alias("held"), entry.alias("at"), F.array().cast("array<int>").alias("starts")
    )

    def step(acc: Column, size: Column) -> Column:
        full = (acc["held"] >= max_rows) | (2 + acc["chars"] + size + acc["held"] > max_chars)
        opens = (acc["held"] == 0) | full
        return F.struct(
            F.when(opens, size).otherwise(acc["chars"] + size).alias("chars"),
            F.when(opens, F.lit(1)).otherwise(acc["held"] + 1).alias("held"),
            (acc["at"] + 1).alias("at"),
            F.when(opens, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"),
        )

    return F.aggregate(F.slice(sizes, entry + 1, own - entry), start, step, lambda acc: acc["starts"])


def pack_windows(
    reports: DataFrame,
    max_rows: int = LIMITS.reports_per_batch,
    max_chars: int = LIMITS.payload_chars - ARRAY_RESERVE,
    block_rows: int = 4_096,
) -> DataFrame:
    """Cut every window into batches of at most ``max_rows`` reports and
    ``max_chars`` characters of JSON array, newest report first.

    ``reports`` has window_end, seen_at, post_id and size (JSON length). A batch ends
    where the next report would overflow, so where a batch starts depends on
    all batches before it. To keep a crowded window out of one task the window
    is cut into blocks of positions, one row of sizes each. As a batch never
    spans more than ``max_rows`` positions, a block can be entered at
    ``max_rows`` places only. In windows of several blocks each block is folded
    once for every entry, and the small entry-to-exit tables are chained per
    window; other windows are entered at 0. The entry that occurs marks the
    batch starts. Returns the input with ``batch_sequence`` (0-based).
    """
    newest = [F.col("seen_at").desc(), F.col("post_id").desc()]
    reports = cut_lineage(reports)  # ids and sizes only, read several times below
    placed = number_rows(reports, ["window_end"], newest, -F.unix_seconds("seen_at"), "position")
    block = F.floor((F.col("position") - 1) / block_rows)
    placed = placed.withColumn("_block", block).withColumn("_at", ((F.col("position") - 1) % block_rows).cast("int"))
    lean = placed.select("window_end", "_block", "_at", F.col("size").cast("bigint").alias("size"))
    # reports just past the block end, needed to see where its last batch ends
    spill = lean.filter((F.col("_at") < max_rows) & (F.col("_block") > 0)).select(
        "window_end", (F.col("_block") - 1).alias("_block"), (F.col("_at") + block_rows).alias("_at"), "size"
    )
    ordered = F.array_sort(F.collect_list(F.struct("_at", "size")))
    sizes = F.transform(ordered, lambda x: x["size"])
    blocks = lean.unionByName(spill).groupBy("window_end", "_block").agg(sizes.alias("_sizes"))
    several = blocks.filter("_block = 1").select("window_end")
    tables = blocks.join(several, "window_end", "left_semi").mapInPandas(
        partial(_block_exits, max_rows, max_chars, block_rows), "window_end timestamp, _block bigint, _exits array<int>"
    )
    entries = tables.groupBy("window_end").applyInPandas(_chain_blocks, "window_end timestamp, _block bigint, _entry int")
    entered = blocks.join(entries, ["window_end", "_block"], "left").withColumn("_entry", F.coalesce("_entry", F.lit(0)))
    own = F.least(F.lit(block_rows), F.size("_sizes"))
    starts = _batch_starts(F.col("_sizes"), F.col("_entry"), own, max_rows, max_chars)
    marks = entered.select("window_end", "_block", F.explode(starts).alias("_at"), F.lit(1).cast("bigint").alias("_start"))
    marked = placed.join(marks, ["window_end", "_block", "_at"], "left").withColumn(
        "_start", F.coalesce("_start", F.lit(0).cast("bigint"))
    )
    numbered = running_sum(marked, ["window_end"], ["position"], F.col("_block"), F.col("_start"), "_seq")
    return numbered.withColumn("batch_sequence", F.col("_seq") - 1).drop("_seq", "_start", "_at", "position")


def window_reports(posts: DataFrame, sources: DataFrame) -> DataFrame:
    """Posts that are neither deleted nor noise, with their window and the length of their compact report."""
    named = join_few(posts.filter("not is_deleted and not is_noise"), sources.select("source_id", F.col("name").alias("source_name")), "source_id")
    seen = F.coalesce("published_at", "observed_at")
    return named.select(
        window_end(seen).alias("window_end"),
        window_start(seen).alias("window_start"),
        seen.alias("seen_at"),
        "post_id",
        F.char_length(report_json()).cast("bigint").alias("size"),
    )


def batch_key(window: Column, sequence: Column) -> Column:
    """Durable key of a batch."""
    return F.concat(F.date_format(window, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(":"), sequence.cast("string"))


def next_sequences(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Sequence of new batches per window, after the existing ones."""
    taken = existing.groupBy("window_end").agg((F.max("batch_sequence") + 1).alias("_base"))
    numbered = number_rows(new, ["window_end"], ["batch_id"], id_block(F.col("batch_id")), "_n")
    return (
        numbered.join(taken, "window_end", "left")
        .withColumn("batch_sequence", F.coalesce("_base", F.lit(0)) + F.col("_n") - 1)
        .drop("_base", "_n")
    )


def density_groups(posts: DataFrame, size: int = 28, groups: int = 10) -> DataFrame:
    """Evenly spaced runs of consecutive posts, in time order. Fewer than ``size`` posts are an error.

    Positions come from blocked numbering; only the rows of the groups leave
    the scan.
    """
    seen = F.coalesce("published_at", "observed_at")
    placed = number_rows(
        posts.select("post_id", seen.alias("seen_at")), [], ["seen_at", "post_id"], time_block(F.col("seen_at")), "position"
    )
    enough = F.when(F.count("*") >= size, F.count("*"))
    total = posts.agg(F.coalesce(enough, F.raise_error(F.lit(f"fewer than {size} posts"))).alias("total"))
    starts = total.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group_no"), "total").select(
        "group_no",
        F.floor(F.col("group_no") * (F.col("total") - size) / max(1, groups - 1)).alias("start"),
    )
    wanted = starts.select(
        "group_no", F.explode(F.sequence(F.col("start") + 1, F.col("start") + size)).alias("position")
    )
    return placed.join(F.broadcast(wanted), "position").select("group_no", "position", "post_id")
