"""Schemas of the tables the engine reads."""

SEEDS = (
    "source_key STRING, name STRING, telegram_username STRING, role STRING, priority_tier STRING, "
    "category STRING, language STRING, source_type STRING, trust_score DOUBLE, is_wire_origin BOOLEAN"
)
SOURCES = (
    "source_id BIGINT, source_key STRING, name STRING, username STRING, role STRING, priority_tier STRING, "
    "category STRING, language STRING, source_type STRING, trust_score DOUBLE, is_wire_origin BOOLEAN, "
    "is_active BOOLEAN, health_status STRING, last_polled_at TIMESTAMP, next_poll_at TIMESTAMP, "
    "last_seen_message_id BIGINT, last_error STRING"
)
PAGES = (
    "source_id BIGINT, source_key STRING, username STRING, url STRING, html STRING, fetched_at TIMESTAMP"
)
POSTS = (
    "post_id BIGINT, source_id BIGINT, message_id BIGINT, canonical_url STRING, update_type STRING, "
    "published_at TIMESTAMP, edited_at TIMESTAMP, observed_at TIMESTAMP, language STRING, "
    "original_text STRING, normalized_text STRING, content_hash STRING, media_type STRING, metadata STRING, "
    "is_deleted BOOLEAN, is_noise BOOLEAN, noise_reason STRING, processing_status STRING, "
    "analysis_content_hash STRING, analysis_lease_at TIMESTAMP, analysis_attempts INT"
)
PROPOSALS = (
    "batch_id BIGINT, cluster_no INT, post_ids ARRAY<BIGINT>, classification STRING, confidence DOUBLE"
)
JUDGMENTS = (
    "batch_id BIGINT, left_post_id BIGINT, right_post_id BIGINT, relationship STRING, confidence DOUBLE"
)
DECISIONS = (
    "batch_id BIGINT, decision_no INT, post_ids ARRAY<BIGINT>, action STRING, event_id BIGINT, "
    "duplicate_of_post_id BIGINT, confidence DOUBLE, canonical_fact STRING, category STRING, reason STRING"
)
MANIFEST = (
    "version INT, sample STRING, start TIMESTAMP, end TIMESTAMP, post_ids ARRAY<BIGINT>, "
    "windows ARRAY<STRUCT<window_end: TIMESTAMP, post_ids: ARRAY<BIGINT>>>"
)
