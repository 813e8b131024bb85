"""End-to-end plans composed from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.operators.clusters import judge_pairs, proposed_pairs, resolve_proposals, star_clusters, veto_pairs
from corroborate.operators.editorial import score_events
from corroborate.operators.evidence import (
    attach_evidence,
    copied_from,
    event_facts,
    origin_groups,
    propagate_origins,
    verify_events,
)
from corroborate.operators.posts import normalize_posts, upsert_raw_posts
from corroborate.session import cut_lineage
from corroborate.sources.pages import changed_posts, page_warnings, parse_pages, to_envelopes


def ingest(pages: DataFrame, stored: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Landed pages to (stored posts, quarantined pages)."""
    quarantined = page_warnings(pages)
    changed = changed_posts(parse_pages(pages), stored)
    envelopes = to_envelopes(changed, sources).withColumn("seq", F.unix_micros("observed_at"))
    return normalize_posts(upsert_raw_posts(stored, envelopes)), quarantined


def vetted_pairs(
    first: DataFrame, correction: DataFrame, batch_posts: DataFrame, judgments: DataFrame, posts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Resolved partitions and their judged pairs after the place veto.

    Both are read several times further on, so they are materialized once:
    they hold ids and confidences only, not texts.
    """
    resolved = cut_lineage(resolve_proposals(first, correction, batch_posts))
    judged = cut_lineage(judge_pairs(proposed_pairs(resolved), judgments))
    return resolved, veto_pairs(judged, posts)


def clusters(
    first: DataFrame, correction: DataFrame, batch_posts: DataFrame, judgments: DataFrame, posts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Event clusters of every batch, and the pairs they were rebuilt from."""
    resolved, pairs = vetted_pairs(first, correction, batch_posts, judgments, posts)
    return star_clusters(resolved, pairs), pairs


def confirmed_events(links: DataFrame, posts: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Which reported events are independently confirmed, and how much they matter.

    Reports are grouped by origin, origins by event. A report that repeats one
    of the thirty before it counts for the origin it copied.
    """
    evidence = attach_evidence(links, posts, sources)
    traced = propagate_origins(evidence, copied_from(evidence))
    verified = verify_events(origin_groups(traced))
    events = event_facts(evidence).join(verified, "event_id").withColumn("event_state", F.lit("active"))
    scored = score_events(events, now)
    return scored.select(
        "event_id", "verification_status", "independent_confirmation_count", "source_count",
        "category", "importance_score", "band",
    ).orderBy(F.col("importance_score").desc(), "event_id")
