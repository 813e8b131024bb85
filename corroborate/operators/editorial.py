"""Scores, gates, candidates, updates, publication order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.config import LIMITS
from corroborate.functions.caption import fallback_description, fallback_title, story_is_persian
from corroborate.functions.scoring import adjust, band, subscores, weighted_score
from corroborate.functions.timefn import age_hours
from corroborate.operators.blocks import first_per_key, previous_value, running_sum
from corroborate.operators.evidence import top_evidence


def score_events(events: DataFrame, now: Column) -> DataFrame:
    """Subscores, score, band and reasons of every event."""
    hours = age_hours(F.col("first_seen_at"), now)
    parts = subscores(
        F.col("category"), F.col("verification_status"), F.col("independent_confirmation_count"),
        F.col("age_hours"), F.col("event_state"),
    )
    names = list(parts)
    return (
        events.withColumn("age_hours", hours)
        .withColumns(parts)
        .withColumn("importance_score", weighted_score({n: F.col(n) for n in names}))
        .withColumn("band", band(F.col("importance_score")))
        .withColumn(
            "reasons",
            F.array(
                F.concat(F.lit("category:"), "category"),
                F.concat(F.lit("verification:"), "verification_status"),
                F.concat(F.lit("independent_confirmations:"), F.col("independent_confirmation_count").cast("string")),
                F.concat(F.lit("age_hours:"), F.floor(F.col("age_hours") + F.lit(0.5)).cast("string")),
            ),
        )
    )


def editorial_gate(scored: DataFrame, judgments: DataFrame) -> DataFrame:
    """Recommendation and effective score of every scored event.

    Below the gate the score decides; above it a judgment does, and a missing
    or invalid judgment leaves the event on MONITOR at its own score.
    """
    score = F.col("importance_score")
    valid = F.coalesce(
        F.col("recommendation").isin("PUBLISH", "MONITOR", "IGNORE")
        & F.coalesce(F.col("adjustment"), F.lit(0)).between(-20, 20)
        & (F.char_length("judge_reason") <= 500),
        F.lit(False),
    )
    asked = score >= LIMITS.editor_gate
    used = asked & valid
    verdict = judgments.select(
        "event_id", "event_version", "recommendation", "adjustment",
        F.col("reason").alias("judge_reason"), F.col("breaking").alias("judge_breaking"),
    )
    return (
        scored.join(verdict, ["event_id", "event_version"], "left")
        .withColumn("used_judgment", used)
        .withColumn(
            "recommendation",
            F.when(F.col("used_judgment"), F.col("recommendation"))
            .when(asked, F.lit("MONITOR"))
            .when(score >= LIMITS.monitor_score, F.lit("MONITOR"))
            .otherwise(F.lit("IGNORE")),
        )
        .withColumn(
            "effective_score",
            F.when(F.col("used_judgment"), adjust(score, F.coalesce("adjustment", F.lit(0)))).otherwise(score),
        )
        .withColumn(
            "editor_reason",
            F.when(F.col("used_judgment"), F.col("judge_reason"))
            .when(asked, F.lit("ai_editor_unavailable"))
            .otherwise(F.lit("below_ai_editor_gate")),
        )
        .withColumn(
            "breaking_candidate",
            F.when(F.col("used_judgment"), F.coalesce("judge_breaking", F.lit(False)))
            .when(asked, F.col("band") == "BREAKING")
            .otherwise(F.lit(False)),
        )
        .withColumn("effective_band", band(F.col("effective_score")))
        .drop("judge_reason", "judge_breaking", "adjustment")
    )


def should_publish(published_today: Column) -> Column:
    """Verification, budget and score gates; null-free boolean."""
    status, score = F.col("verification_status"), F.col("effective_score")
    breaking = score >= LIMITS.breaking_score
    budget = F.when(breaking, F.lit(LIMITS.busy_day_stories)).otherwise(F.lit(LIMITS.daily_stories))
    allowed = (
        F.when(status == "UNVERIFIED", F.lit(False))
        .when((status == "DEVELOPING") & ~(breaking & F.col("high_priority")), F.lit(False))
        .when((status == "DISPUTED") & ~breaking, F.lit(False))
        .when((published_today >= budget) & ~breaking, F.lit(False))
        .otherwise(score >= LIMITS.publish_score)
    )
    return F.coalesce(allowed, F.lit(False))


def judgment_allows() -> Column:
    """No judgment, PUBLISH, or a breaking candidate on MONITOR."""
    return (
        ~F.col("used_judgment")
        | (F.col("recommendation") == "PUBLISH")
        | (
            (F.col("recommendation") == "MONITOR")
            & F.col("breaking_candidate")
            & (F.col("effective_score") >= LIMITS.breaking_score)
        )
    )


def should_edit() -> Column:
    """Is a newer version different enough from the published story?"""
    confirmed = (F.col("verification_status") == "CONFIRMED") & (
        F.col("independent_confirmation_count") >= F.col("published_confirmations") + 2
    )
    more = (F.col("effective_score") >= LIMITS.breaking_score) & (
        F.col("independent_confirmation_count") > F.col("published_confirmations")
    )
    material = (F.col("verification_status") != F.col("published_status")) | confirmed | more
    newer = F.col("published_message_id").isNotNull() & (F.col("event_version") > F.col("published_version"))
    return F.coalesce(newer & material, F.lit(False))


def published_stories(stories: DataFrame) -> DataFrame:
    """The first published story of every event, as columns to compare with."""
    published = stories.filter("publication_state = 'published'")
    return first_per_key(published, ["event_id"], ["story_id"]).select(
        "event_id",
        F.col("publish_key").alias("published_key"),
        F.col("event_version").alias("published_version"),
        F.col("message_id").alias("published_message_id"),
        F.col("verification_status").alias("published_status"),
        F.col("independent_confirmations").alias("published_confirmations"),
    )


def candidate_rows(
    gated: DataFrame, tiers: DataFrame, stories: DataFrame, published_today: Column, publishing: bool = True
) -> DataFrame:
    """Decision and status of every event version."""
    rows = gated.join(tiers, "event_id", "left").withColumn("high_priority", F.coalesce("high_priority", F.lit(False)))
    rows = rows.join(published_stories(stories), "event_id", "left")
    has_story = F.col("published_key").isNotNull()
    queued, pending = ("update_queued", "update_pending"), ("queued", "pending")
    return (
        rows.withColumn("publish", ~has_story & judgment_allows() & should_publish(published_today))
        .withColumn("material_update", has_story & should_edit())
        .withColumn(
            "decision",
            F.when(F.col("publish"), F.lit("PUBLISH"))
            .when(F.col("effective_score") >= LIMITS.monitor_score, F.lit("MONITOR"))
            .otherwise(F.lit("IGNORE")),
        )
        .withColumn(
            "status",
            F.when(F.col("material_update"), F.lit(queued[0] if publishing else queued[1]))
            .when(F.col("publish") & F.lit(publishing), F.lit(pending[0]))
            .otherwise(F.lit(pending[1])),
        )
        .withColumn(
            "reason_json",
            F.to_json(
                F.concat(
                    "reasons",
                    F.array(
                        F.concat(
                            F.lit("ai_editor:"),
                            F.when(F.col("used_judgment"), F.col("recommendation")).otherwise(F.lit("fallback")),
                        ),
                        F.concat(F.lit("ai_editor_reason:"), "editor_reason"),
                        F.concat(F.lit("effective_score:"), F.col("effective_score").cast("string")),
                    ),
                )
            ),
        )
    )


def block_stories(candidates: DataFrame, drafts: DataFrame) -> DataFrame:
    """Candidates whose drafted story fails the language gate are blocked instead of queued.

    ``drafts`` has event_id, event_version, title and description. Only events
    that are to be published or updated get a draft; one without is left as it is.
    """
    gate = F.coalesce(story_is_persian(F.col("title"), F.col("description")), F.lit(False))
    judged = drafts.select("event_id", "event_version", (~gate).alias("_blocked"))
    joined = candidates.join(judged, ["event_id", "event_version"], "left")
    blocked = F.coalesce("_blocked", F.lit(False))
    status = (
        F.when(blocked & F.col("material_update"), F.lit("update_story_blocked"))
        .when(blocked & F.col("publish"), F.lit("story_blocked"))
        .otherwise(F.col("status"))
    )
    return joined.withColumn("status", status).drop("_blocked")


def daily_budget(candidates: DataFrame, day: str, order: list, block: Column) -> DataFrame:
    """Which publishable candidates of a day fit the budget.

    Scores at or above breaking pass anyway but still use up the day. All
    eligible rows are admitted until the budget is full, so the position among
    them decides exactly.
    """
    eligible = F.col("eligible").cast("bigint")
    numbered = running_sum(candidates, [day], order, block, eligible, "eligible_rank")
    breaking = F.col("score") >= LIMITS.breaking_score
    return numbered.withColumn(
        "admitted", F.col("eligible") & (breaking | (F.col("eligible_rank") <= LIMITS.daily_stories))
    )


def classify_update(previous: str = "previous", current: str | None = None) -> Column:
    """Change class of a version against the one before it."""

    def old(name: str) -> Column:
        return F.col(f"{previous}.{name}")

    def new(name: str) -> Column:
        return F.col(f"{current}.{name}" if current else name)

    drop = old("importance_score") - new("importance_score")
    new_fact = old("core_fact") != new("core_fact")
    new_status = old("verification_status") != new("verification_status")
    unchanged = ~new_fact & ~new_status & (drop == 0)
    contradicted = new_status & ((new("verification_status") == "DISPUTED") | (old("verification_status") == "CONFIRMED"))
    return (
        F.when(unchanged, F.lit("NO_CHANGE"))
        .when(contradicted, F.lit("CONTRADICTION"))
        .when(new_fact & (drop >= 15), F.lit("CORRECTION"))
        .when((F.abs(drop) >= 15) | new_fact, F.lit("MAJOR_UPDATE"))
        .otherwise(F.lit("MINOR_UPDATE"))
    )


def version_changes(history: DataFrame, block_versions: int = 1_024) -> DataFrame:
    """Every event version with its change class.

    The version before is found in version blocks, so an event with very many
    versions is not sorted in one task. First versions have no change class.
    """
    state = F.struct("core_fact", "verification_status", "importance_score", "event_version")
    paired = previous_value(
        history, ["event_id"], ["event_version"], F.floor(F.col("event_version") / block_versions), state, "previous"
    )
    first = F.col("previous").isNull()
    return paired.withColumn("update_type", F.when(~first, classify_update())).withColumn(
        "published_update_type",
        F.when(~first, classify_published(F.col("previous.verification_status"), F.col("verification_status"))),
    )


def classify_published(previous: Column, current: Column) -> Column:
    """Change class of a published story."""
    return (
        F.when((previous == "CONFIRMED") & (current == "DISPUTED"), F.lit("CONTRADICTION"))
        .when(previous != current, F.lit("MAJOR_UPDATE"))
        .otherwise(F.lit("MINOR_UPDATE"))
    )


def update_snapshots(changes: DataFrame) -> DataFrame:
    """Previous and new state of every changed version, as JSON."""
    current = F.struct("core_fact", "verification_status", "importance_score", "event_version")
    return changes.filter("update_type is not null and update_type <> 'NO_CHANGE'").select(
        "event_id",
        "event_version",
        "update_type",
        F.to_json("previous").alias("previous_snapshot"),
        F.to_json(current).alias("new_snapshot"),
    )


def draft_stories(events: DataFrame, evidence: DataFrame, tags: DataFrame) -> DataFrame:
    """Stories without a written text: fallback texts, links, tags, language gate."""
    best = top_evidence(evidence, 5)
    links = best.groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("evidence_rank", F.col("name").alias("label"), F.col("canonical_url").alias("url")))).alias("_l")
    )
    plain = F.transform(F.col("_l"), lambda x: F.struct(x["label"].alias("label"), x["url"].alias("url")))
    title = fallback_title(F.col("core_fact"))
    text = fallback_description(
        F.col("core_fact"), F.col("verification_status"), F.col("independent_confirmation_count")
    )
    return (
        events.join(links.select("event_id", plain.alias("links")), "event_id", "left")
        .join(tags, "event_id", "left")
        .withColumn("title", title)
        .withColumn("description", text)
        .withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
        .withColumn("primary_sources", F.slice("links", 1, 3))
        .withColumn("publishable", story_is_persian(F.col("title"), F.col("description")))
    )


def claim_publication(jobs: DataFrame, stories: DataFrame, locks: DataFrame | None = None) -> DataFrame:
    """The first job of an event wins the event; later keys are suppressed.

    An event published under another key is closed to new keys, and so is one
    that another key has locked in an earlier run, whatever the lock's state.
    ``locks`` has (event_id, publish_key), one row for each event. The winner
    is an aggregate (smallest creation time, then key), not a sorted window.
    """
    winners = jobs.groupBy("event_id").agg(
        F.min_by("publish_key", F.struct("created_at", "publish_key")).alias("_winner")
    )
    if locks is not None:
        held = locks.select("event_id", F.col("publish_key").alias("_lock"))
        winners = winners.join(held, "event_id", "left").select(
            "event_id", F.coalesce("_lock", "_winner").alias("_winner")
        )
    published = stories.filter("publication_state = 'published'").groupBy("event_id").agg(
        F.min("publish_key").alias("_min_key"), F.max("publish_key").alias("_max_key")
    )
    other = F.coalesce(
        (F.col("_min_key") != F.col("publish_key")) | (F.col("_max_key") != F.col("publish_key")), F.lit(False)
    )
    won = (F.col("publish_key") == F.col("_winner")) & ~other
    return (
        jobs.join(winners, "event_id")
        .join(published, "event_id", "left")
        .withColumn("status", F.when(won, F.lit("processing")).otherwise(F.lit("suppressed_duplicate")))
        .drop("_winner", "_min_key", "_max_key")
    )


def pending_publications(candidates: DataFrame, events: DataFrame, stories: DataFrame, k: int = 2) -> DataFrame:
    """Publications still to be made, most important first."""
    same = stories.select(
        "event_id", "event_version", F.col("publish_key").alias("pending_publish_key"), F.col("publication_state").alias("_state")
    )
    done = stories.filter("publication_state = 'published'").select(
        "event_id",
        F.col("publish_key").alias("published_publish_key"),
        F.col("event_version").alias("published_event_version"),
        F.col("message_id").alias("published_message_id"),
    )
    return (
        candidates.filter("decision = 'PUBLISH'")
        .filter(F.col("status").isin("pending", "failed", "update_pending", "update_failed"))
        .join(events.select("event_id", "importance_score"), "event_id")
        .join(same, ["event_id", "event_version"], "left")
        .join(done, "event_id", "left")
        .filter(F.col("_state").isNull() | F.col("_state").isin("pending", "failed"))
        .filter(F.col("published_event_version").isNull() | (F.col("published_event_version") < F.col("event_version")))
        .drop("_state")
        .orderBy(F.col("importance_score").desc(), "event_id", "event_version")
        .limit(k)
    )


def stale_publications(stories: DataFrame, candidates: DataFrame, now: Column, k: int = 2) -> DataFrame:
    """Unfinished stories older than ten minutes, oldest first."""
    cutoff = now - F.expr(f"interval {LIMITS.stale_minutes} minutes")
    stuck = stories.filter(F.col("publication_state").isin("pending", "failed", "processing") & (F.col("updated_at") < cutoff))
    wanted = candidates.filter("decision = 'PUBLISH'").select("event_id", "event_version")
    return stuck.join(wanted, ["event_id", "event_version"]).orderBy("updated_at", "publish_key").limit(k)


def oldest_stale(df: DataFrame, state: str, lease: str, fallback: str, now: Column, key: str, k: int = 1) -> DataFrame:
    """rows in a state whose lease is missing or too old, oldest first."""
    cutoff = now - F.expr(f"interval {LIMITS.stale_minutes} minutes")
    stale = F.col(lease).isNull() | (F.col(lease) < cutoff)
    return df.filter((F.col("status") == state) & stale).orderBy(F.coalesce(lease, fallback), key).limit(k)


def events_with_candidates(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """C14: events with decision, status and score of their own version."""
    notes = candidates.select(
        "event_id", "event_version", "decision", F.col("status").alias("candidate_status"), F.col("score").alias("editorial_score")
    )
    return events.join(notes, ["event_id", "event_version"], "left")
