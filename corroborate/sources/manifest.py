"""Evaluation manifests: read, check, build, sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.functions.text import first_non_empty
from corroborate.functions.timefn import window_end
from corroborate.schemas import MANIFEST


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per (window_end, post_id) of a manifest file."""
    manifest = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    windows = manifest.select(F.explode("windows").alias("w"))
    return windows.select("w.window_end", F.explode("w.post_ids").alias("post_id"))


def check_manifest(entries: DataFrame, posts: DataFrame, expected: int = 500) -> DataFrame:
    """Totals of a manifest; ``valid`` if unique, complete and found."""
    found = posts.select("post_id").distinct().withColumn("_found", F.lit(1))
    return (
        entries.join(found, "post_id", "left")
        .agg(
            F.count("*").alias("entries"),
            F.count_distinct("post_id").alias("unique_posts"),
            F.count_distinct("window_end").alias("windows"),
            F.count_if(F.col("_found").isNull()).alias("missing"),
        )
        .withColumn("valid", (F.col("entries") == expected) & (F.col("unique_posts") == expected) & (F.col("missing") == 0))
    )


def seen_at() -> Column:
    return F.coalesce("published_at", "observed_at")


def latest_sample(posts: DataFrame, size: int, start=None, end=None) -> DataFrame:
    """The latest clean posts with a text, optionally within bounds."""
    kept = posts.filter(~F.col("is_deleted") & ~F.col("is_noise"))
    kept = kept.filter(first_non_empty(F.col("normalized_text"), F.col("original_text")).isNotNull())
    if start is not None:
        kept = kept.filter(seen_at() >= start)
    if end is not None:
        kept = kept.filter(seen_at() <= end)
    return kept.orderBy(seen_at().desc(), F.col("post_id").desc()).limit(size)


def sample_by_ids(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """The clean posts of an id list, with a text."""
    kept = posts.filter(~F.col("is_deleted") & ~F.col("is_noise"))
    kept = kept.filter(first_non_empty(F.col("normalized_text"), F.col("original_text")).isNotNull())
    return kept.join(ids.select("post_id"), "post_id", "left_semi")


def build_manifest(posts: DataFrame, start=None, end=None, size: int = 500) -> DataFrame:
    """The latest posts grouped by window, newest post first.

    The sample bounds the lists: at most ``size`` ids meet in one window.
    """
    sample = latest_sample(posts, size, start, end).select(
        window_end(seen_at()).alias("window_end"), seen_at().alias("seen_at"), "post_id"
    )
    newest_first = F.reverse(F.array_sort(F.collect_list(F.struct("seen_at", "post_id"))))
    return sample.groupBy("window_end").agg(
        F.transform(newest_first, lambda s: s["post_id"]).alias("post_ids")
    )
