"""Landed channel pages: scan, cap, quarantine, message parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.config import LIMITS, TRANSPORT
from corroborate.functions import html as H
from corroborate.functions.origin import cited_source
from corroborate.operators.blocks import join_few
from corroborate.schemas import PAGES

MAX_MESSAGE_ID = 9_007_199_254_740_991


def cap_pages(pages: DataFrame, max_bytes: int = LIMITS.max_html_bytes) -> DataFrame:
    """A1: cap every page in bytes, at least 64,000."""
    return pages.withColumn("html", H.bounded_html(F.col("html"), max(LIMITS.min_html_bytes, max_bytes)))


def read_pages(spark: SparkSession, path: str, max_bytes: int = LIMITS.max_html_bytes) -> DataFrame:
    """A1: scan landed pages from parquet."""
    return cap_pages(spark.read.schema(PAGES).parquet(path), max_bytes)


def page_warnings(pages: DataFrame) -> DataFrame:
    """A3: pages to quarantine, with the reason; such a page fails as a whole."""
    return pages.withColumn("warning", H.page_warning(F.col("html"))).filter("warning is not null")


def message_segments(pages: DataFrame) -> DataFrame:
    """A2: one row per message marker; the segment runs to the next marker."""
    pieces = F.filter(F.split("html", f"(?={H.MARKER})"), lambda p: p.rlike("^" + H.MARKER))
    kept = [c for c in pages.columns if c != "html"]
    segments = pages.select(*kept, F.explode(pieces).alias("segment"))
    key = F.regexp_extract("segment", r'^data-post="([^"]+)"', 1)
    message_id = F.element_at(F.split(key, "/"), -1).try_cast("bigint")
    return (
        segments.withColumn("post_key", key)
        .withColumn("message_id", message_id)
        .filter((F.col("message_id") > 0) & (F.col("message_id") <= MAX_MESSAGE_ID))
    )


def parse_pages(pages: DataFrame) -> DataFrame:
    """A2: posts of every page, one narrow pass without a shuffle."""
    segment = F.col("segment")
    fields = (
        message_segments(pages)
        .withColumn("text", H.message_text(segment))
        .withColumn("edited", H.is_edited(segment))
        .withColumn("media_type", H.media_type(segment))
        .withColumn("canonical_url", F.concat(F.lit(H.URL_PREFIX), "post_key"))
    )
    metadata = F.to_json(
        F.struct(
            F.lit(TRANSPORT).alias("transport"),
            F.col("source_key"),
            F.char_length(segment).alias("page_segment_length"),
            F.col("media_type").isNotNull().alias("has_media"),
            F.col("edited").alias("is_edited"),
            H.forwarded_from(segment).alias("forwarded_from"),
            cited_source(F.col("text")).alias("cited_source"),
        )
    )
    return fields.select(
        "source_id",
        "source_key",
        "username",
        "message_id",
        "canonical_url",
        H.message_time(segment).alias("published_at"),
        F.when(F.col("edited"), F.col("fetched_at")).alias("edited_at"),
        "text",
        "media_type",
        H.content_hash(F.col("canonical_url"), F.col("text"), F.col("media_type")).alias("content_hash"),
        F.substring(segment, 1, LIMITS.snippet_chars).alias("raw_html_snippet"),
        metadata.alias("metadata"),
        F.col("fetched_at").alias("observed_at"),
    )


def changed_posts(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """B2: posts whose fingerprint is new or different."""
    key = ["source_id", "message_id", "content_hash"]
    return parsed.join(stored.select(*key), key, "left_anti")


def update_type(message_id: Column, last_seen: Column) -> Column:
    """An id at or below the source cursor is an edit."""
    return F.when(last_seen.isNotNull() & (message_id <= last_seen), F.lit("edit")).otherwise(F.lit("create"))


def to_envelopes(changed: DataFrame, sources: DataFrame) -> DataFrame:
    """Changed posts as ingest envelopes; a registry that is not large is broadcast, so texts are not dealt out by source."""
    cursors = sources.select("source_id", "last_seen_message_id", "language")
    return (
        join_few(changed, cursors, "source_id", "left")
        .withColumn("update_type", update_type(F.col("message_id"), F.col("last_seen_message_id")))
        .withColumn("schema_version", F.lit(1))
        .withColumn("transport", F.lit(TRANSPORT))
        .drop("last_seen_message_id")
    )
