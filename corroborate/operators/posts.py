"""Stored posts: merge of the envelope log, state changes, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.config import LIMITS
from corroborate.functions.text import first_non_empty, noise_reason, normalize_text, trim_spaces
from corroborate.functions.timefn import is_stale
from corroborate.session import compute_once

KEY = ["source_id", "message_id"]
LEGACY = ("embedding", "embedded", "processing")
STATES = ("queued", "analyzing", "analyzed", "noise")
LAST_COLUMNS = ("canonical_url", "update_type", "observed_at", "language", "content_hash", "raw_html_snippet", "metadata")


def fold_envelopes(envelopes: DataFrame) -> DataFrame:
    """The envelope log reduced to one row per message.

    Every column is an order statistic over ``seq`` (the order of arrival), so
    partial aggregation takes the load of a message that is edited very often.
    """
    seq = F.col("seq")
    edit = F.col("update_type") == "edit"
    delete = F.col("update_type") == "delete"
    return envelopes.groupBy(*KEY).agg(
        F.max_by(F.struct(*LAST_COLUMNS), seq).alias("last"),
        F.min_by("published_at", F.when(F.col("published_at").isNotNull(), seq)).alias("published_at"),
        F.min(seq).alias("first_seq"),
        F.max(F.when(edit, seq)).alias("edit_seq"),
        F.max_by("observed_at", F.when(edit, seq)).alias("edit_observed"),
        F.min_by("edited_at", seq).alias("first_edited_at"),
        F.max_by(F.struct("text"), F.when(edit, seq)).alias("edit_text"),
        F.min_by("text", seq).alias("first_text"),
        F.min_by("observed_at", seq).alias("first_observed"),
        F.max_by("media_type", F.when(F.col("media_type").isNotNull(), seq)).alias("media_type"),
        F.bool_or(delete).alias("any_delete"),
        F.min("content_hash").alias("min_hash"),
        F.max("content_hash").alias("max_hash"),
    )


def upsert_raw_posts(current: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Merge the envelope log into the stored posts by (source, message).

    Columns keep the first value, take the last one, or stick, as §1.4 of the
    survey lists. Status, hash, lease and attempts are reset unless every
    envelope carries the stored hash, none deletes, and the post is live.
    """
    log = fold_envelopes(envelopes)
    stored = current.select(*KEY, F.struct(*[c for c in current.columns if c not in KEY]).alias("old"))
    j = stored.join(log, KEY, "full_outer")
    old, last = F.col("old"), F.col("last")
    known, touched = old.isNotNull(), last.isNotNull()
    later_edit = F.col("edit_seq").isNotNull() & (known | (F.col("edit_seq") > F.col("first_seq")))
    first_text = F.when(known, old["original_text"]).otherwise(F.col("first_text"))
    text = F.when(F.col("edit_text").isNotNull(), F.col("edit_text.text")).otherwise(first_text)
    first_norm = F.when(known, old["normalized_text"]).otherwise(trim_spaces(F.col("first_text")))
    normalized = F.when(F.col("edit_text").isNotNull(), trim_spaces(F.col("edit_text.text"))).otherwise(first_norm)
    unchanged = F.coalesce(
        known
        & ~old["is_deleted"]
        & ~F.col("any_delete")
        & (F.col("min_hash") == old["content_hash"])
        & (F.col("max_hash") == old["content_hash"]),
        F.lit(False),
    )
    merged = {
        **{c: last[c] for c in LAST_COLUMNS},
        "published_at": F.coalesce(old["published_at"], F.col("published_at")),
        "edited_at": F.when(later_edit, F.col("edit_observed"))
        .when(known, old["edited_at"])
        .otherwise(F.col("first_edited_at")),
        "original_text": text,
        "normalized_text": normalized,
        "media_type": F.coalesce(F.col("media_type"), old["media_type"]),
        "is_deleted": F.coalesce(old["is_deleted"], F.lit(False)) | F.col("any_delete"),
        "is_noise": F.coalesce(old["is_noise"], F.lit(False)),
        "noise_reason": old["noise_reason"],
        "processing_status": F.when(unchanged, old["processing_status"]).otherwise(F.lit("pending")),
        "analysis_content_hash": F.when(unchanged, old["analysis_content_hash"]),
        "analysis_lease_at": F.when(unchanged, old["analysis_lease_at"]),
        "analysis_attempts": F.when(unchanged, old["analysis_attempts"]).otherwise(F.lit(0)),
        "created_at": F.coalesce(old["created_at"], F.col("first_observed")),
        "updated_at": last["observed_at"],
    }
    names = [c for c in current.columns if c not in KEY]
    columns = [F.when(touched, merged[c]).otherwise(old[c]).alias(c) if c in merged else old[c].alias(c) for c in names]
    return j.select(*KEY, *columns)


def current_status(status: Column) -> Column:
    """Legacy and unknown states count as pending."""
    return F.when(status.isin(*STATES), status).otherwise(F.lit("pending"))


def normalize_posts(posts: DataFrame) -> DataFrame:
    """Clean text, noise flags and the next state of every post."""
    done = F.col("processing_status").isin("noise", "analyzed") & (
        F.col("analysis_content_hash") == F.col("_hash")
    )
    filtered = F.col("is_deleted") | F.col("_reason").isNotNull()
    clean = compute_once(posts.drop("normalized_text"), "normalized_text", normalize_text(F.col("original_text")))
    return (
        compute_once(clean, "_reason", noise_reason(F.col("normalized_text")))
        .withColumn("_hash", F.sha2("normalized_text", 256))
        .withColumn(
            "_next",
            F.when(filtered, F.lit("noise"))
            .when(F.coalesce(done, F.lit(False)), F.col("processing_status"))
            .otherwise(current_status(F.col("processing_status"))),
        )
        .withColumns(
            {
                "is_noise": filtered,
                "noise_reason": F.col("_reason"),
                "processing_status": F.col("_next"),
                "analysis_content_hash": F.when(F.col("_next").isin("noise", "analyzed"), F.col("_hash")).otherwise(
                    F.col("analysis_content_hash")
                ),
                "analysis_lease_at": F.when(~F.col("_next").isin("noise", "analyzed"), F.col("analysis_lease_at")),
            }
        )
        .select(*posts.columns)
    )


def mark_noise(posts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Posts a decision calls noise."""
    noise = (
        decisions.filter("action = 'NOISE'")
        .select(F.explode("post_ids").alias("post_id"))
        .distinct()
        .withColumn("_noise", F.lit(True))
    )
    hit = F.coalesce("_noise", F.lit(False))
    text_hash = F.sha2(first_non_empty(F.col("normalized_text"), F.col("original_text")), 256)
    return (
        posts.join(noise, "post_id", "left")
        .withColumns(
            {
                "processing_status": F.when(hit, F.lit("noise")).otherwise(F.col("processing_status")),
                "is_noise": hit | F.col("is_noise"),
                "noise_reason": F.when(hit, F.lit("llm_noise")).otherwise(F.col("noise_reason")),
                "analysis_content_hash": F.when(hit, F.coalesce("analysis_content_hash", text_hash)).otherwise(
                    F.col("analysis_content_hash")
                ),
                "analysis_lease_at": F.when(~hit, F.col("analysis_lease_at")),
            }
        )
        .drop("_noise")
    )


def requeue_legacy(posts: DataFrame) -> DataFrame:
    """Unfinished states of the old pipeline return to the queue."""
    old = F.col("processing_status").isin(*LEGACY)
    return posts.withColumns(
        {
            "processing_status": F.when(old, F.lit("pending")).otherwise(F.col("processing_status")),
            "analysis_lease_at": F.when(~old, F.col("analysis_lease_at")),
        }
    )


def eligible(posts: DataFrame) -> DataFrame:
    """Live, clean, pending posts."""
    return posts.filter(~F.col("is_deleted") & ~F.col("is_noise") & (F.col("processing_status") == "pending"))


def arrived_at() -> Column:
    return F.coalesce("created_at", "observed_at")


def batch_due(posts: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """Pending and overdue counts, and whether a batch is due at ``now``."""
    overdue = arrived_at() <= now - F.expr(f"interval {LIMITS.window_minutes} minutes")
    by_clock = (F.minute(now) % LIMITS.window_minutes == 0) & (F.second(now) < 30)
    counts = eligible(posts).agg(F.count("*").alias("pending"), F.count_if(overdue).alias("overdue"))
    return counts.withColumn("due", (F.col("pending") > 0) & (F.lit(force) | by_clock | (F.col("overdue") > 0)))


def orphan_posts(posts: DataFrame, items: DataFrame, batches: DataFrame, now: Column) -> DataFrame:
    """Analyzing posts with a stale lease that no live batch holds."""
    live = items.join(batches.filter(F.col("status").isin("queued", "processing")), "batch_id").select("post_id")
    return posts.filter(
        ~F.col("is_deleted") & (F.col("processing_status") == "analyzing") & is_stale(F.col("analysis_lease_at"), now)
    ).join(live, "post_id", "left_anti")


def release_posts(posts: DataFrame, items: DataFrame) -> DataFrame:
    """Analyzing posts of the given batch items go back to pending."""
    held = items.select("post_id").distinct().withColumn("_held", F.lit(True))
    back = F.coalesce(F.col("_held"), F.lit(False)) & (F.col("processing_status") == "analyzing")
    return (
        posts.join(held, "post_id", "left")
        .withColumns(
            {
                "processing_status": F.when(back, F.lit("pending")).otherwise(F.col("processing_status")),
                "analysis_lease_at": F.when(~back, F.col("analysis_lease_at")),
            }
        )
        .drop("_held")
    )


def load_reports(posts: DataFrame, sources: DataFrame, ids: DataFrame) -> DataFrame:
    """Posts of an id list with the name and key of their source."""
    wanted = posts.join(ids.select("post_id"), "post_id", "left_semi")
    return wanted.join(
        sources.select("source_id", F.col("name").alias("source_name"), "source_key"), "source_id"
    )


def search_posts(posts: DataFrame, status: str, query: str) -> DataFrame:
    """Status or noise filter and a case-blind substring search."""
    kept = posts
    if status == "noise":
        kept = kept.filter("is_noise")
    elif status != "all":
        kept = kept.filter(F.col("processing_status") == status)
    haystack = F.lower(F.concat_ws(" ", "source_name", "original_text", "normalized_text"))
    needle = query.strip().lower()
    return kept.filter(haystack.contains(needle)) if needle else kept


def search_events(events: DataFrame, status: str) -> DataFrame:
    """Events of one verification status, or all."""
    return events if status == "all" else events.filter(F.col("verification_status") == status)
