"""Operations: counters, telemetry, overview and feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions.text import ellipsize, first_non_empty
from corroborate.functions.timefn import day_key, round_half_up
from corroborate.operators.blocks import distribution, join_null_safe

OVERVIEW_METRICS = (
    "posts_observed", "raw_posts_persisted", "events_created", "events_scored",
    "stories_published", "poll_envelopes_queued", "queue_failures",
)


def counters(log: DataFrame) -> DataFrame:
    """D3: additive counters per day and metric."""
    return log.groupBy(day_key(F.col("ts")).alias("counter_date"), "metric").agg(F.sum("amount").alias("value"))


def registry_totals(sources: DataFrame) -> DataFrame:
    """Sources known and active."""
    return sources.agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"))


def batch_telemetry(attempts: DataFrame) -> DataFrame:
    """HTTP histogram, retries, tokens and latency per batch."""
    status = F.col("status")
    named = (200, 429, 502, 503, 504)
    return attempts.groupBy("batch_id").agg(
        F.count("*").alias("physical_attempts"),
        *[F.count_if(status == s).alias(f"http_{s}") for s in named],
        F.count_if(status.between(500, 599) & ~status.isin(502, 503, 504)).alias("other_5xx"),
        F.count_if(status.isNull()).alias("transport_failures"),
        F.count_if(F.col("logical_attempt") > 1).alias("retries"),
        F.count_if((F.col("logical_attempt") > 1) & (status == 200)).alias("retry_recoveries"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
    )


def succeeded() -> Column:
    return F.coalesce(F.col("status").between(200, 299), F.lit(False))


def provider_distribution(attempts: DataFrame) -> DataFrame:
    """Calls, outcomes and fallback wins per provider."""
    ok = succeeded()
    return attempts.groupBy(F.coalesce(first_non_empty(F.col("provider")), F.lit("unknown")).alias("provider")).agg(
        F.count("*").alias("calls"),
        F.count_if(ok).alias("success"),
        F.count_if(~ok).alias("failure"),
        F.count_if(ok & (F.col("fallback_attempts") > 0)).alias("fallback_wins"),
    )


def routed_models(attempts: DataFrame) -> DataFrame:
    """Calls per routed model."""
    return attempts.filter("routed_model is not null").groupBy("routed_model").agg(F.count("*").alias("calls"))


MEASURES = ("report_count", "active_event_count", "prompt_chars", "schema_chars", "prompt_tokens", "latency_ms")


def provider_behavior(attempts: DataFrame) -> DataFrame:
    """Medians of six measures over successful attempts, per provider.

    The measures are stacked and their values counted, so one shuffle serves
    all exact medians.
    """
    good = attempts.filter(succeeded()).withColumn("provider", F.coalesce(first_non_empty(F.col("provider")), F.lit("unknown")))
    stacked = good.select(
        "provider",
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in MEASURES])
        ).alias("m"),
    ).select("provider", "m.*")
    medians = (
        distribution(stacked, ["provider", "measure"], "value", {})
        .groupBy("provider")
        .agg(
            *[
                F.max(F.when(F.col("measure") == m, round_half_up(F.col("median"), 2))).alias(f"median_{m}")
                for m in MEASURES
            ]
        )
    )
    totals = good.groupBy("provider").agg(
        F.count("*").alias("requests"),
        F.coalesce(F.sum("fallback_attempts"), F.lit(0)).alias("fallback_attempts"),
        F.array_join(F.sort_array(F.collect_set("routed_model")), ",").alias("routed_models"),
    )
    return totals.join(medians, "provider", "left")


def latency_summary(attempts: DataFrame, keys: list[str], value: str = "latency_ms") -> DataFrame:
    """Average, median, nearest-rank p50/p95 and maximum of a measure."""
    spread = distribution(attempts, keys, value, {"p50": 0.5, "p95": 0.95})
    means = attempts.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        round_half_up(F.sum(value) / F.count(value), 2).alias("average")
    )
    return join_null_safe(spread, means, keys).withColumn("median", round_half_up(F.col("median"), 2))


def overview(sources: DataFrame, counts: DataFrame, usage: DataFrame, day: str) -> DataFrame:
    """One row: source health, counters of the day, usage of the day."""
    registry = sources.agg(
        F.count("*").alias("sources_total"),
        F.count_if("is_active").alias("sources_active"),
        F.count_if(F.coalesce(F.col("health_status") != "healthy", F.lit(True))).alias("sources_degraded"),
        F.max("last_polled_at").alias("latest_poll_at"),
    )
    today = counts.filter(F.col("counter_date") == day).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("value"))), F.lit(0)).alias(m)
            for m in OVERVIEW_METRICS
        ]
    )
    used = usage.filter(F.col("day") == day).agg(
        F.coalesce(F.sum("calls"), F.lit(0)).alias("ai_calls"), F.coalesce(F.sum("cost"), F.lit(0)).alias("ai_cost")
    )
    one = F.lit(1).alias("_one")
    rows = [df.select(one, "*") for df in (registry, today, used)]
    return reduce(lambda a, b: a.join(b, "_one"), rows).drop("_one")


def latest(df: DataFrame, at: Column, key: str, k: int) -> DataFrame:
    """the ``k`` latest rows; the key breaks ties."""
    return df.orderBy(at.desc(), F.col(key).desc()).limit(k)


def activity(posts: DataFrame, events: DataFrame, stories: DataFrame, sources: DataFrame, k: int = 60) -> DataFrame:
    """One feed of the latest posts, events, stories and failing sources."""
    post_at = F.coalesce("published_at", "observed_at")
    recent_posts = latest(posts, post_at, "post_id", 30).select(
        F.concat(F.lit("post-"), F.col("post_id").cast("string")).alias("id"),
        F.lit("post").alias("kind"),
        F.col("observed_at").alias("ts"),
        F.concat("source_name", F.lit(" / message "), F.col("message_id").cast("string")).alias("title"),
        ellipsize(F.coalesce(first_non_empty(F.col("original_text")), F.lit("Media-only post")), 180).alias("detail"),
        F.when(F.col("is_noise"), F.lit("muted")).otherwise(F.lit("cyan")).alias("tone"),
    )
    recent_events = latest(events, F.col("last_updated_at"), "event_id", 20).select(
        F.concat(
            F.lit("event-"), F.col("event_id").cast("string"), F.lit("-v"), F.col("event_version").cast("string")
        ).alias("id"),
        F.lit("event").alias("kind"),
        F.col("last_updated_at").alias("ts"),
        F.concat("verification_status", F.lit(" · "), ellipsize(F.col("core_fact"), 120)).alias("title"),
        F.concat(
            F.col("source_count").cast("string"), F.lit(" sources · score "), F.col("importance_score").cast("string")
        ).alias("detail"),
        F.when(F.col("verification_status") == "CONFIRMED", F.lit("lime"))
        .when(F.col("verification_status") == "DISPUTED", F.lit("coral"))
        .otherwise(F.lit("amber"))
        .alias("tone"),
    )
    state = F.col("publication_state")
    recent_stories = latest(stories, F.coalesce("published_at", "created_at"), "story_id", 20).select(
        F.concat(F.lit("story-"), F.col("story_id").cast("string")).alias("id"),
        F.lit("publish").alias("kind"),
        F.coalesce("published_at", "created_at").alias("ts"),
        F.when(state == "published", F.lit("Story published")).otherwise(F.concat(F.lit("Story "), state)).alias("title"),
        ellipsize(
            F.when(F.col("last_error").isNotNull(), F.concat("title", F.lit(" · "), "last_error")).otherwise(F.col("title")), 180
        ).alias("detail"),
        F.when(state == "published", F.lit("lime")).when(state == "failed", F.lit("coral")).otherwise(F.lit("amber")).alias("tone"),
    )
    failing = sources.filter(first_non_empty(F.col("last_error")).isNotNull())
    failing = failing.orderBy(F.col("is_active").desc(), "health_status", "source_id").limit(10)
    polled = F.col("last_polled_at")
    recent_failures = failing.select(
        F.concat(
            F.lit("source-"),
            F.col("source_id").cast("string"),
            F.lit("-"),
            F.coalesce(F.date_format(polled, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("unknown")),
        ).alias("id"),
        F.lit("source").alias("kind"),
        F.coalesce(polled, F.lit("1970-01-01").cast("timestamp")).alias("ts"),
        F.concat("name", F.lit(" · "), "health_status").alias("title"),
        ellipsize(F.col("last_error"), 180).alias("detail"),
        F.lit("coral").alias("tone"),
    )
    feed = recent_posts.unionByName(recent_events).unionByName(recent_stories).unionByName(recent_failures)
    return feed.orderBy(F.col("ts").desc(), "kind", "id").limit(k)
