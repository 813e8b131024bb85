"""Windowed rates; the same plans serve batch and streaming inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(log: DataFrame, width: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Rows per time window; ``delay`` sets the watermark of a stream."""
    rows = log.withWatermark("ts", delay) if delay else log
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(window).agg(F.count("*").alias("publications")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "publications"
    )


def cycle_rates(log: DataFrame, delay: str | None = None) -> DataFrame:
    """Publications per five-minute cycle."""
    return windowed_counts(log, "5 minutes", None, delay)


def sliding_rates(log: DataFrame, delay: str | None = None) -> DataFrame:
    """Publications per hour, every five minutes.

    The grid is five minutes, so this approximates the exact trailing hour,
    which the batch limiter computes.
    """
    return windowed_counts(log, "60 minutes", "5 minutes", delay)


def running_counters(log: DataFrame) -> DataFrame:
    """Additive counters per day and metric (update mode on a stream)."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("counter_date")
    return log.groupBy(day, "metric").agg(F.sum("amount").alias("value"))
