"""Source registry: seeds, upsert, polling schedule and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.config import LIMITS
from corroborate.operators.blocks import previous_value, time_block
from corroborate.schemas import SEEDS

DESCRIPTIVE = (
    "name", "source_type", "username", "public_url", "language", "category",
    "priority_tier", "role", "trust_score", "is_wire_origin",
)
EPOCH = "1970-01-01"


def _registry_columns(seeds: DataFrame) -> DataFrame:
    return seeds.withColumnRenamed("telegram_username", "username").withColumn(
        "public_url", F.concat(F.lit("https://t.me/"), "username")
    )


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """A4: registry seeds from a JSON array file."""
    return _registry_columns(spark.read.schema(SEEDS).option("multiLine", True).json(path))


def seeds_from_json(rows: DataFrame, column: str) -> DataFrame:
    """A4: registry seeds from a column of JSON objects."""
    return _registry_columns(rows.select(F.from_json(column, SEEDS).alias("s")).select("s.*"))


def upsert_sources(current: DataFrame, seeds: DataFrame) -> DataFrame:
    """A5: new keys start inactive; known keys keep activity, health and cursors.

    New keys get the next ids in the order of the keys. The window over all
    of them is one task: a registry has a row for each channel, not for each
    post.
    """
    fresh = seeds.select("source_key", *[F.col(c).alias(f"_new_{c}") for c in DESCRIPTIVE], F.lit(True).alias("_seeded"))
    joined = current.join(fresh, "source_key", "full_outer")
    new = F.sum(F.when(F.col("source_id").isNull(), 1).otherwise(0)).over(Window.orderBy("source_key"))
    last = F.coalesce(F.max("source_id").over(Window.partitionBy()), F.lit(0))
    joined = joined.withColumn("source_id", F.coalesce("source_id", last + new))
    described = {c: F.when(F.col("_seeded"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in DESCRIPTIVE}
    return joined.withColumns(
        {
            **described,
            "is_active": F.coalesce("is_active", F.lit(False)),
            "health_status": F.coalesce("health_status", F.lit("pending_validation")),
        }
    ).select(*current.columns)


def due_sources(sources: DataFrame, now, limit: int = LIMITS.poll_batch_size) -> DataFrame:
    """B1: active sources whose poll is due, longest waiting first."""
    due = F.col("is_active") & (F.col("next_poll_at").isNull() | (F.col("next_poll_at") <= now))
    waiting = F.coalesce("next_poll_at", F.lit(EPOCH).cast("timestamp"))
    return sources.filter(due).orderBy(waiting, "source_id").limit(limit)


def poll_gaps(polls: DataFrame) -> DataFrame:
    """Polls whose earliest visible id lies beyond the cursor of the source.

    ``polls`` has source_id, polled_at, poll_id, earliest_id and latest_id;
    the cursor is the latest id of the last poll that saw one.
    """
    seen = previous_value(
        polls, ["source_id"], ["polled_at", "poll_id"], time_block(F.col("polled_at"), 86_400),
        F.col("latest_id"), "cursor",
    )
    gap = F.coalesce(F.col("earliest_id") > F.col("cursor") + 1, F.lit(False))
    return seen.withColumn("gap_suspected", gap)


def apply_poll_log(sources: DataFrame, polls: DataFrame, interval: int = LIMITS.poll_interval_seconds) -> DataFrame:
    """Schedule, health and cursor of each source after its polls.

    ``polls`` has source_id, polled_at, poll_id, ok, latest_id and error. All
    outputs are order statistics, so a busy source is reduced map-side.
    """
    order = F.struct("polled_at", "poll_id")
    last = polls.groupBy("source_id").agg(
        F.max_by(F.struct("ok", "polled_at", "error"), order).alias("_last"),
        F.max(F.when(F.col("ok"), F.col("polled_at"))).alias("_success"),
        F.max_by("latest_id", F.when(F.col("ok") & F.col("latest_id").isNotNull(), order)).alias("_cursor"),
    )
    retry = min(interval * 2, LIMITS.max_retry_seconds)
    wait = F.when(F.col("_last.ok"), F.lit(interval)).otherwise(F.lit(retry))
    polled = F.col("_last").isNotNull()
    return (
        sources.join(last, "source_id", "left")
        .withColumns(
            {
                "last_polled_at": F.coalesce("_success", "last_polled_at"),
                "next_poll_at": F.when(
                    polled, F.timestamp_micros(F.unix_micros("_last.polled_at") + wait * 1_000_000)
                ).otherwise(F.col("next_poll_at")),
                "last_seen_message_id": F.coalesce("_cursor", "last_seen_message_id"),
                "health_status": F.when(
                    polled, F.when(F.col("_last.ok"), F.lit("healthy")).otherwise(F.lit("degraded"))
                ).otherwise(F.col("health_status")),
                "last_error": F.when(
                    polled,
                    F.when(~F.col("_last.ok"), F.substring("_last.error", 1, LIMITS.error_chars)),
                ).otherwise(F.col("last_error")),
            }
        )
        .select(*sources.columns)
    )
