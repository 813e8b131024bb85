"""Limits, thresholds and fixed values of the engine.

Everything an operator might want to change is a field of :class:`Limits`;
operators take the values as parameters and default to these.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    # pages
    max_html_bytes: int = 524_288
    min_html_bytes: int = 64_000
    snippet_chars: int = 12_000
    # polling
    poll_interval_seconds: int = 300
    poll_batch_size: int = 5
    max_retry_seconds: int = 3_600
    error_chars: int = 500
    # batches
    window_minutes: int = 5
    reports_per_batch: int = 32
    cluster_posts: int = 40
    payload_chars: int = 60_000
    report_chars: int = 1_800
    fact_chars: int = 800
    active_events: int = 40
    event_horizon_hours: int = 48
    fresh_minutes: int = 15
    stale_minutes: int = 10
    # judgments
    pair_confidence: float = 0.95
    ambiguity: float = 0.72
    copy_overlap: float = 0.86
    copy_lookback: int = 30
    # editorial
    editor_gate: int = 75
    monitor_score: int = 60
    publish_score: int = 78
    breaking_score: int = 90
    daily_stories: int = 15
    busy_day_stories: int = 25
    # quotas
    pair_calls_per_day: int = 1_400
    batch_calls_per_day: int = 500
    judge_calls_per_day: int = 250
    story_calls_per_day: int = 40
    covers_per_day: int = 10
    cover_cost: int = 500
    daily_cost_budget: int = 8_000
    usage_high: int = 1_100
    usage_critical: int = 1_250
    telemetry_entries: int = 2_048
    # publication limiter
    publish_per_cycle: int = 1
    publish_per_hour: int = 2
    publish_total: int = 5
    caption_chars: int = 900
    # largest side we are willing to broadcast
    broadcast_rows: int = 50_000


LIMITS = Limits()

# --- fixed values -----------------------------------------------------------
# Enumerations of the data model; results depend on the exact spelling.
CATEGORIES = ("IRAN", "WORLD", "POLITICS", "WAR_SECURITY", "SOCIETY", "ECONOMY", "TECHNOLOGY")
ACTIONS = (
    "MATCH_EXISTING_EVENT",
    "NEW_EVENT",
    "DUPLICATE",
    "UPDATE_EXISTING_EVENT",
    "NOISE",
    "UNCERTAIN",
)
CLASSIFICATIONS = ("EVENT", "NOISE", "UNCERTAIN")
RELATIONSHIPS = ("SAME_EVENT", "DIFFERENT_EVENT", "UNCERTAIN")
STATUSES = ("CONFIRMED", "DEVELOPING", "DISPUTED", "UNVERIFIED")
UPDATE_TYPES = ("create", "edit", "delete")
TRANSPORT = "telegram_public_web"
