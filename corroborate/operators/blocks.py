"""Sequence operators that do not put a whole key into one task.

A plain window over a key sorts all rows of that key in one task, which fails
when one key holds a large part of the table. The operators here cut the key
into *blocks*: ``block`` is a column that never decreases along the order (a
minute, an id range). Rows are sorted inside (key, block); only one row per
block takes part in the window over the whole key, and what came before the
block is joined back to its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.config import LIMITS
from corroborate.session import cut_lineage

ID_BLOCK = 65_536


def id_block(c: Column, width: int = ID_BLOCK) -> Column:
    return F.floor(c / width)


def time_block(ts: Column, seconds: int = 60) -> Column:
    return F.floor(F.unix_seconds(ts) / seconds)


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on named columns in which null equals null."""
    renamed = reduce(lambda df, c: df.withColumnRenamed(c, f"_r_{c}"), on, right)
    condition = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in on])
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def join_few(df: DataFrame, few: DataFrame, on: str, how: str = "inner", most: int = LIMITS.broadcast_rows) -> DataFrame:
    """Inner or left join with a table that mostly is short, such as the sources.

    Up to ``most`` rows are broadcast, so that ``df``, which may hold texts, is not dealt out by a key of few values;
    more are shuffled. The short table is computed once, for the count and the join.
    """
    few = cut_lineage(few)
    return df.join(F.broadcast(few) if few.count() <= most else few, on, how)


def running_sum(
    df: DataFrame, keys: list[str], order: list, block: Column, value: Column, name: str
) -> DataFrame:
    """Inclusive running sum of ``value`` per key; ``order`` must be total."""
    parts = [*keys, "_block"]
    blocked = df.withColumn("_block", block).withColumn("_value", value)
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        blocked.groupBy(*parts)
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .drop("_total")
    )
    local = blocked.withColumn("_local", F.sum("_value").over(inside))
    return (
        join_null_safe(local, before, parts)
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_block", "_value", "_local", "_before")
    )


def number_rows(df: DataFrame, keys: list[str], order: list, block: Column, name: str) -> DataFrame:
    """1-based position of every row in its key."""
    return running_sum(df, keys, order, block, F.lit(1).cast("bigint"), name)


def previous_value(
    df: DataFrame, keys: list[str], order: list, block: Column, value: Column, name: str
) -> DataFrame:
    """Last non-null ``value`` before each row of its key."""
    parts = [*keys, "_block"]
    blocked = df.withColumn("_block", block).withColumn("_value", value)
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last_of_block = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))
    carried = (
        blocked.groupBy(*parts)
        .agg(last_of_block.alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier))
        .drop("_last")
    )
    local = blocked.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    return (
        join_null_safe(local, carried, parts)
        .withColumn(name, F.coalesce("_local", "_carry"))
        .drop("_block", "_value", "_local", "_carry")
    )


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The row with the smallest ``order`` per key, by aggregation."""
    return _pick(df, keys, F.min_by(F.struct(*df.columns), F.struct(*order)))


def last_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The row with the largest ``order`` per key, by aggregation."""
    return _pick(df, keys, F.max_by(F.struct(*df.columns), F.struct(*order)))


def _pick(df: DataFrame, keys: list[str], choice: Column) -> DataFrame:
    return df.groupBy(*keys).agg(choice.alias("_row")).select("_row.*")


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int, name: str = "_rank") -> DataFrame:
    """First ``k`` rows per key; Spark prunes each key to ``k`` before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def trailing_counts(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Rows in the closed trailing interval ending at each distinct instant.

    Equal instants are counted first, so a burst is one row. The count in
    ``[t - seconds, t]`` is the difference of two running counts: one at ``t``
    and one just before ``t - seconds``. Returns one row per instant with
    ``micros``, ``n`` (rows at the instant), ``running`` and ``trailing``.
    """
    width = seconds * 1_000_000
    instants = df.groupBy(F.unix_micros(F.col(ts)).alias("micros")).agg(F.count("*").alias("n"))
    marks = instants.select("micros", F.lit(1).alias("kind"), "n").unionByName(
        instants.select((F.col("micros") - width).alias("micros"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("n"))
    )
    summed = running_sum(
        marks, [], ["micros", "kind"], F.floor(F.col("micros") / 60_000_000), F.col("n"), "running"
    )
    at = summed.filter("kind = 1").select("micros", "n", "running")
    before = summed.filter("kind = 0").select((F.col("micros") + width).alias("micros"), F.col("running").alias("_out"))
    return (
        at.join(before, "micros")
        .withColumn("trailing", F.col("running") - F.col("_out"))
        .drop("_out")
    )


def quantile_block(df: DataFrame, keys: list[str], value: str, blocks: int, name: str) -> DataFrame:
    """``df`` with the number of its value block per key: blocks end at sketched quantiles, so all hold about as many rows.

    The sketch only says where blocks end; what is computed inside and across them stays exact.
    """
    cuts = F.percentile_approx(value, [i / blocks for i in range(1, blocks)], 20 * blocks)
    edges = df.groupBy(*keys).agg(cuts.alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda cut: cut < F.col(value)))
    return join_null_safe(df, edges, keys).withColumn(name, below).drop("_cuts")


def distribution(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], blocks: int = 64) -> DataFrame:
    """Count, exact median, nearest-rank percentiles and maximum per key.

    Equal values are counted first, so the rows that meet in one task are
    distinct values of one value block, not measurements. Blocks end at
    quantiles of the distinct values, whatever their range.
    """
    if not keys:
        return distribution(df.withColumn("_all", F.lit(1)), ["_all"], value, fractions, blocks).drop("_all")
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = quantile_block(counted, keys, value, blocks, "_place")
    ranked = running_sum(placed, keys, [value], F.col("_place"), F.col("_n"), "_upto").drop("_place")
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("samples"))
    joined = join_null_safe(ranked, totals, keys)
    samples = F.col("samples")

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") >= rank, F.col(value)))

    low = at_rank(F.floor((samples + 1) / 2))
    high = at_rank(F.floor(samples / 2) + 1)
    columns = [F.max("samples").alias("samples"), ((low + high) / F.lit(2.0)).alias("median")]
    for name, fraction in fractions.items():
        rank = F.least(samples, F.greatest(F.lit(1), F.ceil(samples * F.lit(fraction))))
        columns.append(at_rank(rank).alias(name))
    columns.append(F.max(value).alias("maximum"))
    return joined.groupBy(*keys).agg(*columns)
