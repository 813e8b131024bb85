"""Evidence: copies, origin groups, verification, entities, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.config import LIMITS
from corroborate.functions.origin import (
    default_origin,
    origin_type,
    own_origin,
    relationship_confidence,
)
from corroborate.functions.text import (
    entity_keys,
    first_non_empty,
    infer_category,
    refutes,
    set_overlap,
    tokens,
)
from corroborate.operators.blocks import join_few, number_rows, running_sum, time_block, top_per_key
from corroborate.operators.pointers import follow
from corroborate.session import compute_once, cut_lineage

EVENT_ORDER = ["attached_at", "post_id"]


def attach_evidence(links: DataFrame, posts: DataFrame, sources: DataFrame) -> DataFrame:
    """(event, post) links with the post text and the source attributes.

    Columns are chosen by name, so a post id never shadows a source id.
    """
    reports = posts.select(
        "post_id",
        "source_id",
        "metadata",
        first_non_empty(F.col("normalized_text"), F.col("original_text")).alias("text"),
    )
    profile = sources.select("source_id", "source_key", "name", "role", "priority_tier", "trust_score", "is_wire_origin")
    return join_few(links.join(reports, "post_id"), profile, "source_id")


def within_size_ratio(left: Column, right: Column, threshold: float) -> Column:
    """Sets this different in size cannot overlap by ``threshold``."""
    return F.least(left, right) >= F.greatest(left, right) * F.lit(threshold)


def copied_from(
    evidence: DataFrame, threshold: float = LIMITS.copy_overlap, lookback: int = LIMITS.copy_lookback
) -> DataFrame:
    """For each evidence row the latest of the ``lookback`` rows of the
    same event before it whose token overlap reaches ``threshold``.

    Rows are numbered per event in blocks, by ids and times alone, and cut into
    runs of ``lookback`` positions. A row can only look into its own run and
    the one before, so each row is sent to its run and, as context, to the
    next one: a group holds at most two runs however large the event is. Two
    sets that overlap enough share one of their first few tokens in hash
    order, so most pairs end with a look at these; sizes come first. Rows are
    looked at from the latest on, so among many copies a row meets its parent
    at once and its set is not compared with those before.
    """
    rows = evidence.select("event_id", "post_id", "attached_at")
    placed = number_rows(rows, ["event_id"], EVENT_ORDER, time_block(F.col("attached_at")), "position")
    run = F.floor((F.col("position") - 1) / lookback)
    targets = F.array(
        F.struct(run.alias("run"), F.lit(True).alias("mine")), F.struct((run + 1).alias("run"), F.lit(False).alias("mine"))
    )
    sets = compute_once(evidence.select("event_id", "post_id", "text"), "tokens", tokens(F.col("text"))).drop("text")
    reach = F.size("tokens") - F.ceil(F.size("tokens") * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    first = F.slice(F.sort_array(F.transform("tokens", lambda t: F.xxhash64(t))), F.lit(1), reach)
    sets = compute_once(sets.filter(F.size("tokens") > 0), "first", first)
    sent = sets.join(placed.select("event_id", "post_id", "position"), ["event_id", "post_id"])
    sent = sent.select("event_id", "post_id", "position", "tokens", "first", F.explode(targets).alias("t"))
    newest_first = F.sort_array(F.collect_list(F.struct("position", "post_id", "tokens", "first", "t.mine")), asc=False)
    groups = sent.groupBy("event_id", "t.run").agg(newest_first.alias("rows"))

    def latest_parent(row: Column, others: Column) -> Column:
        """The first fit: rows come newest first, and behind it no more sets are compared."""
        distance = lambda other: row["position"] - other["position"]
        fits = lambda other: (
            distance(other).between(1, lookback)
            & within_size_ratio(F.size(row["tokens"]), F.size(other["tokens"]), threshold)
            & F.arrays_overlap(row["first"], other["first"])
            & (set_overlap(row["tokens"], other["tokens"]) >= threshold)
        )
        none = F.lit(None).cast(dict(sent.dtypes)["post_id"])
        return F.aggregate(others, none, lambda found, other: F.when(found.isNotNull(), found).when(fits(other), other["post_id"]))

    found = F.transform(
        F.filter("rows", lambda row: row["mine"]),
        lambda row: F.struct(row["post_id"].alias("post_id"), latest_parent(row, F.col("rows")).alias("parent_post_id")),
    )
    return (
        groups.select("event_id", F.explode(found).alias("f"))
        .select("event_id", "f.post_id", "f.parent_post_id")
        .filter("parent_post_id is not null")
    )


def copy_pairs(batch_posts: DataFrame, threshold: float = LIMITS.copy_overlap) -> DataFrame:
    """Pairs of posts of one batch whose token overlap reaches ``threshold``.

    ``batch_posts`` has batch_id, post_id and text. Batches are packed to a
    few dozen posts, which bounds the pairs per post; identical token sets are
    compared by size first and then by intersection.
    """
    sets = batch_posts.select("batch_id", "post_id", tokens(F.col("text")).alias("tokens"))
    left = sets.toDF("batch_id", "left_post_id", "_left")
    right = sets.toDF("batch_id", "right_post_id", "_right")
    overlap = set_overlap(F.col("_left"), F.col("_right"))
    return (
        left.join(right, "batch_id")
        .filter("left_post_id < right_post_id")
        .filter(within_size_ratio(F.size("_left"), F.size("_right"), threshold))
        .withColumn("overlap", overlap)
        .filter(F.col("overlap") >= threshold)
        .drop("_left", "_right")
    )


def own_origins(evidence: DataFrame) -> DataFrame:
    """Origin type and group of evidence rows that copy nothing."""
    group = F.coalesce(
        own_origin(F.col("metadata")),
        default_origin(F.col("is_wire_origin"), F.col("source_key"), F.col("source_id")),
    )
    kind = origin_type(F.col("metadata"), F.col("is_wire_origin"), F.col("role"))
    return evidence.withColumn("origin_type", kind).withColumn("origin_group", group)


def propagate_origins(evidence: DataFrame, copies: DataFrame) -> DataFrame:
    """Origin type and group of every evidence row.

    A copy takes the group of its parent, which may itself be a copy, unless
    it declares an origin of its own. So a row points at its parent only if it
    has no origin of its own; following the pointers ends at the row whose
    group everybody on the way inherits.
    """
    key = ["event_id", "post_id"]
    own = own_origin(F.col("metadata"))
    fallback = default_origin(F.col("is_wire_origin"), F.col("source_key"), F.col("source_id"))
    rows = evidence.select(*key, own.alias("_own"), fallback.alias("_default")).join(copies, key, "left")
    # ids and origins without texts, read several times below
    rows = cut_lineage(
        rows.select(*key, "parent_post_id", F.col("_own").isNotNull().alias("_declared"), F.coalesce("_own", "_default").alias("_group"))
    )
    inherits = rows.filter("parent_post_id is not null and not _declared")
    roots = follow(inherits, ["event_id"], "post_id", "parent_post_id").select(*key, F.col("last").alias("_root"))
    groups = rows.select("event_id", F.col("post_id").alias("_root"), F.col("_group").alias("_root_group"))
    traced = (
        rows.join(roots, key, "left")
        .join(groups, ["event_id", "_root"], "left")
        .select(*key, "parent_post_id", F.coalesce("_root_group", "_group").alias("origin_group"))
    )
    kind = origin_type(F.col("metadata"), F.col("is_wire_origin"), F.col("role"))
    copied = F.col("parent_post_id").isNotNull()
    return (
        evidence.join(traced, key)
        .withColumn("origin_type", kind)
        .withColumn("relationship_confidence", relationship_confidence(copied, F.col("origin_type")))
        .withColumn("dependency_reason", F.when(copied, F.lit("strong_lexical_copy_relationship")))
        .withColumn("supports_core_fact", ~refutes(F.col("text")))
    )


def can_confirm() -> Column:
    """May an evidence row confirm a fact? Trusted source, and no mere aggregation."""
    first_tier = F.col("priority_tier") == "TIER_1"
    credible = (F.col("trust_score") >= 0.55) | first_tier
    return credible & ((F.col("origin_type") != "aggregation") | first_tier)


def origin_groups(evidence: DataFrame) -> DataFrame:
    """Credibility and support of every origin group of an event.

    Rows are first reduced per source, so a hot group costs each task one row
    per source it saw.
    """
    per_source = (
        evidence.withColumn("_credible", can_confirm())
        .withColumn("_refutes", refutes(F.col("text")))
        .groupBy("event_id", "origin_group", "source_id")
        .agg(
            F.bool_or("_credible").alias("_credible"),
            F.bool_or("_refutes").alias("_refutes"),
            F.count("*").alias("_rows"),
        )
    )
    return per_source.groupBy("event_id", "origin_group").agg(
        F.bool_or("_credible").alias("credible"),
        (~F.bool_or("_refutes")).alias("supports"),
        F.count("*").alias("sources"),
        F.sum("_rows").alias("evidence_rows"),
    )


def verify_events(groups: DataFrame) -> DataFrame:
    """Verification status of every event from its origin groups."""
    confirmations = F.col("independent_confirmation_count")
    return (
        groups.groupBy("event_id")
        .agg(
            F.count_if(F.col("credible") & F.col("supports")).alias("independent_confirmation_count"),
            F.bool_or(~F.col("supports")).alias("_denied"),
            F.sum("evidence_rows").alias("source_count"),
            F.count("*").alias("origin_groups"),
        )
        .withColumn(
            "verification_status",
            F.when(F.col("_denied") & (confirmations > 0), F.lit("DISPUTED"))
            .when(confirmations >= 2, F.lit("CONFIRMED"))
            .when(confirmations == 1, F.lit("DEVELOPING"))
            .otherwise(F.lit("UNVERIFIED")),
        )
        .drop("_denied")
    )


def distinct_sources(evidence: DataFrame) -> DataFrame:
    """Sources per event, each counted once."""
    return evidence.groupBy("event_id").agg(F.count_distinct("source_id").alias("distinct_sources"))


def first_tier_events(evidence: DataFrame) -> DataFrame:
    """Does any TIER_1 source report the event?"""
    return evidence.groupBy("event_id").agg(F.bool_or(F.col("priority_tier") == "TIER_1").alias("high_priority"))


def event_facts(evidence: DataFrame) -> DataFrame:
    """Fact, category and first sight of every event, from its smallest post."""
    first = F.min_by(F.struct("text", "attached_at"), "post_id")
    text = F.col("_first.text")
    return evidence.groupBy("event_id").agg(first.alias("_first"), F.max("attached_at").alias("last_updated_at")).select(
        "event_id",
        F.substring(text, 1, LIMITS.fact_chars).alias("core_fact"),
        infer_category(text).alias("category"),
        F.col("_first.attached_at").alias("first_seen_at"),
        "last_updated_at",
    )


def event_entities(evidence: DataFrame) -> DataFrame:
    """(event, entity) pairs, each once."""
    return evidence.select("event_id", F.explode(entity_keys(F.col("text"))).alias("entity_key")).distinct()


def event_tags(entities: DataFrame, k: int = 8) -> DataFrame:
    """F8: at most ``k`` tags per event, in alphabetical order."""
    kept = top_per_key(entities, ["event_id"], ["entity_key"], k)
    return kept.groupBy("event_id").agg(F.sort_array(F.collect_list("entity_key")).alias("tags"))


def event_versions(evidence: DataFrame) -> DataFrame:
    """Version of the event after each evidence row; a rerun adds nothing.

    ``evidence`` has event_id, post_id, attached_at and bumping.
    """
    bump = F.when(F.col("bumping"), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    once = evidence.groupBy("event_id", "post_id").agg(
        F.min("attached_at").alias("attached_at"), F.min_by("bumping", "attached_at").alias("bumping")
    )
    return running_sum(
        once, ["event_id"], EVENT_ORDER, time_block(F.col("attached_at")), bump, "_bumps"
    ).withColumn("event_version", F.col("_bumps") + 1).drop("_bumps")


def top_evidence(evidence: DataFrame, k: int) -> DataFrame:
    """the best ``k`` evidence rows per event: tier, then trust, then post."""
    order = ["priority_tier", F.col("trust_score").desc(), "post_id"]
    return top_per_key(evidence, ["event_id"], order, k, "evidence_rank")


def post_history(posts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every post with the sorted ids of its events and origin groups."""
    attached = evidence.groupBy("post_id").agg(
        F.sort_array(F.collect_set("event_id")).alias("event_ids"),
        F.sort_array(F.collect_set("origin_group")).alias("origin_groups"),
    )
    return posts.join(attached, "post_id", "left").withColumns(
        {
            "event_ids": F.coalesce("event_ids", F.array().cast("array<bigint>")),
            "origin_groups": F.coalesce("origin_groups", F.array().cast("array<string>")),
        }
    )
