"""Decisions of a batch: contract, duplicate graphs, application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.config import ACTIONS, CATEGORIES, LIMITS
from corroborate.functions.text import first_non_empty, infer_category
from corroborate.operators.blocks import first_per_key, last_per_key
from corroborate.operators.pointers import follow

# --- fixed values -----------------------------------------------------------
INVALID = "intelligence_output_invalid"
UNKNOWN_EVENT = "intelligence_unknown_event_id"
UNKNOWN_POST = "intelligence_unknown_post_id"
UNKNOWN_TARGET = "intelligence_unknown_duplicate_target"
UNEXPECTED = "intelligence_unexpected_post_assignment"
CONTRADICTORY = "intelligence_contradictory_post_assignment"
MISSING = "intelligence_missing_post_assignment"
BAD_TARGET = "intelligence_invalid_duplicate_target"
MISMATCH = "intelligence_action_reference_mismatch"
RECOVERABLE = (CONTRADICTORY, MISSING, BAD_TARGET, MISMATCH)
MAX_DECISIONS = 64
MAX_POSTS = 40
# ----------------------------------------------------------------------------


def _field_code() -> Column:
    """First broken field rule of one decision, or null."""
    c = F.col
    ids = c("post_ids")
    fields_ok = F.coalesce(
        F.size(ids).between(1, MAX_POSTS)
        & F.forall(ids, lambda x: F.coalesce(x > 0, F.lit(False)))
        & c("action").isin(*ACTIONS)
        & (c("event_id").isNull() | (c("event_id") > 0))
        & (c("duplicate_of_post_id").isNull() | (c("duplicate_of_post_id") > 0))
        & c("confidence").between(0.0, 1.0)
        & F.char_length("canonical_fact").between(1, 800)
        & c("category").isin(*CATEGORIES)
        & F.char_length("reason").between(1, 1000),
        F.lit(False),
    )
    needs_event = c("action").isin("MATCH_EXISTING_EVENT", "UPDATE_EXISTING_EVENT")
    duplicate = c("action") == "DUPLICATE"
    target = c("duplicate_of_post_id")
    return (
        F.when(~fields_ok, F.lit(INVALID))
        .when(needs_event != c("event_id").isNotNull(), F.lit(MISMATCH))
        .when(duplicate != target.isNotNull(), F.lit(BAD_TARGET))
        .when(F.size(F.array_distinct(ids)) != F.size(ids), F.lit(INVALID))
        .when(F.array_contains(ids, target), F.lit(BAD_TARGET))
    )


def validate_decisions(
    decisions: DataFrame, expected: DataFrame, known_events: DataFrame, allowed: DataFrame | None = None
) -> DataFrame:
    """First contract failure of every batch, or null, and whether a
    correction may be asked for.

    Failures are ranked: fields in decision order; unknown or repeated
    references in reading order; unexpected posts; missing posts; targets that
    are no event report. Batches that break the field rules are not exploded,
    so a batch contributes at most 64 x 40 ids. ``expected`` and ``allowed``
    have (batch_id, post_id), ``known_events`` (batch_id, event_id).
    """
    allowed = expected if allowed is None else allowed
    batch = Window.partitionBy("batch_id")
    checked = decisions.repartition("batch_id").withColumn("_code", _field_code()).withColumns(
        {
            "_n": F.count("*").over(batch),
            "_first": F.min(F.when(F.col("_code").isNotNull(), F.struct("decision_no", "_code"))).over(batch),
        }
    )
    field = F.when(F.col("_n") > MAX_DECISIONS, F.lit(INVALID)).otherwise(F.col("_first._code"))
    checked = checked.withColumn("_field", field)
    sound = checked.filter("_field is null")
    no = F.col("decision_no").cast("bigint")

    def rows(df: DataFrame, space: str, key: Column | None = None, **facts: Column) -> DataFrame:
        """What one table says about a post, an event or the batch; facts it does not have are null."""
        columns = [F.lit(None).cast(kind).alias(name) if name not in facts else facts[name].cast(kind).alias(name) for name, kind in FACTS]
        return df.select("batch_id", F.lit(space).alias("space"), (F.lit(None) if key is None else key).cast("bigint").alias("id"), *columns)

    members = sound.select("batch_id", "decision_no", "action", F.posexplode("post_ids").alias("pos", "post_id"))
    place = F.struct(no.alias("no"), F.col("pos").cast("int").alias("pos"))
    unsafe = F.col("action").isin("NOISE", "DUPLICATE", "UNCERTAIN")
    true = F.lit(True)
    facts = (
        rows(checked, "batch", decided=true, field=F.col("_field"))
        .unionByName(rows(members, "post", F.col("post_id"), place=place, unsafe=unsafe))
        .unionByName(rows(sound.filter("duplicate_of_post_id is not null"), "post", F.col("duplicate_of_post_id"), target=no))
        .unionByName(rows(sound.filter("event_id is not null"), "event", F.col("event_id"), target=no))
        .unionByName(rows(allowed, "post", F.col("post_id"), known=true))
        .unionByName(rows(expected, "post", F.col("post_id"), wanted=true))
        .unionByName(rows(known_events, "event", F.col("event_id"), known=true))
        .repartition("batch_id")
    )
    each = facts.groupBy("batch_id", "space", "id").agg(
        F.sort_array(F.collect_list("place")).alias("places"),
        *[F.coalesce(F.bool_or(name), F.lit(False)).alias(name) for name in ("unsafe", "known", "wanted", "decided")],
        F.min("target").alias("target"),
        F.min("field").alias("field"),
    )
    first, second = F.get("places", F.lit(0)), F.get("places", F.lit(1))
    named, post, event = F.size("places") > 0, F.col("space") == "post", F.col("space") == "event"
    aimed, known = F.col("target").isNotNull(), F.col("known")

    def fault(when: Column, stage: int, number: Column, pos: Column, code: str) -> Column:
        rank = F.struct(F.lit(stage).alias("stage"), number.cast("bigint").alias("no"), pos.cast("int").alias("pos"))
        return F.when(when, F.struct(rank.alias("rank"), F.lit(code).alias("code")))

    faults = F.array_min(
        F.array_compact(
            F.array(
                fault(event & aimed & ~known, 1, F.col("target"), F.lit(-1), UNKNOWN_EVENT),
                fault(post & named & ~known, 1, first["no"], first["pos"], UNKNOWN_POST),
                fault(post & known & (F.size("places") > 1), 1, second["no"], second["pos"], CONTRADICTORY),
                fault(post & aimed & ~known, 1, F.col("target"), F.lit(MAX_POSTS + 1), UNKNOWN_TARGET),
                fault(post & named & ~F.col("wanted"), 2, first["no"], first["pos"], UNEXPECTED),
                fault(post & F.col("wanted") & ~named, 3, F.lit(0), F.lit(0), MISSING),
                fault(post & aimed & F.col("unsafe"), 4, F.col("target"), F.lit(0), BAD_TARGET),
            )
        )
    )
    found = each.groupBy("batch_id").agg(
        F.bool_or("decided").alias("_decided"), F.min("field").alias("_field"), F.min(faults).alias("_fault")
    )
    code = F.coalesce("_field", "_fault.code")
    return found.filter("_decided").select(
        "batch_id", code.alias("code"), F.coalesce(code.isin(*RECOVERABLE), F.lit(False)).alias("recoverable")
    )


#: What ``validate_decisions`` gathers about posts, events and batches.
FACTS = (
    ("place", "struct<no:bigint,pos:int>"),
    ("target", "bigint"),
    ("unsafe", "boolean"),
    ("known", "boolean"),
    ("wanted", "boolean"),
    ("decided", "boolean"),
    ("field", "string"),
)


def ambiguous_posts(decisions: DataFrame, threshold: float = LIMITS.ambiguity) -> DataFrame:
    """Posts of uncertain or low-confidence decisions."""
    unsure = (F.col("action") == "UNCERTAIN") | (F.col("confidence") < threshold)
    return decisions.filter(unsure).select("batch_id", F.explode("post_ids").alias("post_id")).distinct()


def replace_ambiguous(primary: DataFrame, resolved: DataFrame, uncertain: DataFrame) -> DataFrame:
    """Primary decisions that touch no uncertain post, plus the resolved ones."""
    touched = (
        primary.select("batch_id", "decision_no", F.explode("post_ids").alias("post_id"))
        .join(uncertain, ["batch_id", "post_id"], "left_semi")
        .select("batch_id", "decision_no")
        .distinct()
    )
    kept = primary.join(touched, ["batch_id", "decision_no"], "left_anti")
    return kept.unionByName(resolved.select(*primary.columns))


def coverage_diff(expected: DataFrame, assigned: DataFrame) -> DataFrame:
    """(batch, post) rows expected but not assigned, and the reverse."""
    key = ["batch_id", "post_id"]
    missing = expected.select(*key).distinct().join(assigned.select(*key), key, "left_anti")
    extra = assigned.select(*key).distinct().join(expected.select(*key), key, "left_anti")
    return missing.withColumn("side", F.lit("missing")).unionByName(extra.withColumn("side", F.lit("unexpected")))


def post_actions(decisions: DataFrame) -> DataFrame:
    """Action of every post; the last decision that names it counts."""
    members = decisions.select(
        "batch_id", "decision_no", "action", "duplicate_of_post_id", F.explode("post_ids").alias("post_id")
    )
    return last_per_key(members, ["batch_id", "post_id"], ["decision_no"])


def duplicate_graph(decisions: DataFrame, allowed: DataFrame) -> DataFrame:
    """I8/C11: class of every duplicate edge."""
    actions = post_actions(decisions).select("batch_id", F.col("post_id").alias("target_post_id"), F.col("action").alias("target_action"))
    edges = last_per_key(
        decisions.filter("action = 'DUPLICATE'").select(
            "batch_id", "decision_no", F.explode("post_ids").alias("post_id"), F.col("duplicate_of_post_id").alias("target_post_id")
        ),
        ["batch_id", "post_id"],
        ["decision_no"],
    ).drop("decision_no")
    known = allowed.select("batch_id", F.col("post_id").alias("target_post_id")).distinct().withColumn("_allowed", F.lit(True))
    kind = (
        F.when(F.col("_allowed").isNull() | F.col("target_action").isNull(), F.lit("D_missing_target"))
        .when(F.col("target_post_id") == F.col("post_id"), F.lit("E_cycle"))
        .when(F.col("target_action") == "NOISE", F.lit("B_duplicate_to_noise"))
        .when(F.col("target_action") == "UNCERTAIN", F.lit("C_duplicate_to_uncertain"))
        .when(F.col("target_action") == "DUPLICATE", F.lit("A_duplicate_chain"))
        .otherwise(F.lit("F_other"))
    )
    key = ["batch_id", "target_post_id"]
    return (
        edges.join(actions, key, "left")
        .join(known, key, "left")
        .select("batch_id", "post_id", "target_post_id", "target_action", kind.alias("type"))
    )


EVENT_ACTIONS = ("NEW_EVENT", "MATCH_EXISTING_EVENT", "UPDATE_EXISTING_EVENT")


def resolve_duplicates(decisions: DataFrame) -> DataFrame:
    """Duplicate posts with the event report their chain ends at.

    A cycle, or an end that is no event report, makes the whole batch unsafe:
    its rows then have ``safe = false`` and no target.
    """
    actions = post_actions(decisions)
    edges = actions.filter("action = 'DUPLICATE' and duplicate_of_post_id is not null")
    ends = follow(edges, ["batch_id"], "post_id", "duplicate_of_post_id")
    terminal = actions.select("batch_id", F.col("post_id").alias("last"), F.col("action").alias("_end"))
    judged = ends.join(terminal, ["batch_id", "last"], "left").withColumn(
        "_good", F.col("ended") & F.coalesce(F.col("_end").isin(*EVENT_ACTIONS), F.lit(False))
    )
    verdict = judged.groupBy("batch_id").agg(F.bool_and("_good").alias("safe"))
    return judged.join(verdict, "batch_id").select(
        "batch_id", "post_id", F.when(F.col("safe"), F.col("last")).alias("target_post_id"), "safe"
    )


def resolve_event_ids(decisions: DataFrame, attached: DataFrame, events: DataFrame) -> DataFrame:
    """The event of every decision that is neither noise nor duplicate.

    In order: the event of the first member that already is evidence; the
    event its first post once originated; a new event named after that post.
    ``attached`` has post_id, event_id, seq; ``events`` event_id and
    originating_post_id.
    """
    open_decisions = decisions.filter(~F.col("action").isin("NOISE", "DUPLICATE"))
    members = open_decisions.select("batch_id", "decision_no", F.posexplode("post_ids").alias("pos", "post_id"))
    latest = last_per_key(attached.select("post_id", F.col("event_id").alias("_event"), "seq"), ["post_id"], ["seq"])
    found = (
        members.join(latest, "post_id")
        .groupBy("batch_id", "decision_no")
        .agg(F.min_by("_event", "pos").alias("_attached"))
    )
    origins = events.groupBy(F.col("originating_post_id").alias("_first")).agg(F.max("event_id").alias("_orphan"))
    first = F.col("post_ids")[0]
    return (
        open_decisions.withColumn("_first", first)
        .join(found, ["batch_id", "decision_no"], "left")
        .join(origins, "_first", "left")
        .withColumn("target_event_id", F.coalesce("_attached", "_orphan", "_first"))
        .withColumn("created", F.col("_attached").isNull() & F.col("_orphan").isNull())
        .drop("_first", "_attached", "_orphan")
    )


def events_from_decisions(resolved: DataFrame, posts: DataFrame, now: Column) -> DataFrame:
    """Rows of the events a batch creates, one per originating post."""
    origin = posts.select(
        F.col("post_id").alias("originating_post_id"),
        "published_at",
        first_non_empty(F.col("normalized_text"), F.col("original_text")).alias("_text"),
    )
    fresh = resolved.filter("created").withColumn("originating_post_id", F.col("post_ids")[0])
    fresh = first_per_key(fresh, ["originating_post_id"], ["batch_id", "decision_no"])
    return fresh.join(origin, "originating_post_id").select(
        F.col("target_event_id").alias("event_id"),
        F.substring("canonical_fact", 1, LIMITS.fact_chars).alias("core_fact"),
        F.coalesce(first_non_empty(F.col("category")), infer_category(F.col("_text"))).alias("category"),
        F.coalesce("published_at", now).alias("first_seen_at"),
        now.alias("last_updated_at"),
        "originating_post_id",
        F.lit("active").alias("event_state"),
    )


def batch_items(decisions: DataFrame, resolved: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row per decided post: action, event, target and confidence.

    Duplicates take the event of their target, from this batch or from the
    evidence table. The result is a pure function of its inputs, so applying a
    batch twice through the keyed sinks changes nothing.
    """
    events = resolved.select("batch_id", "decision_no", F.col("target_event_id").alias("event_id"))
    members = decisions.select(
        "batch_id", "decision_no", "action", "duplicate_of_post_id", "confidence", F.explode("post_ids").alias("post_id")
    )
    own = members.filter("action <> 'DUPLICATE'").join(events, ["batch_id", "decision_no"], "left")
    copied = members.filter("action = 'DUPLICATE'").join(
        duplicates.select("batch_id", "post_id", "event_id"), ["batch_id", "post_id"], "left"
    )
    columns = ["batch_id", "post_id", "action", "event_id", "duplicate_of_post_id", "confidence"]
    return (
        own.select(*columns).unionByName(copied.select(*columns)).withColumn("item_status", F.lit("applied"))
    )


def duplicate_events(decisions: DataFrame, resolved: DataFrame, attached: DataFrame) -> DataFrame:
    """Event of every duplicate post: that of its target in this batch, else as attached."""
    in_batch = resolved.select(
        "batch_id", F.explode("post_ids").alias("duplicate_of_post_id"), F.col("target_event_id").alias("_batch")
    )
    latest = last_per_key(
        attached.select(F.col("post_id").alias("duplicate_of_post_id"), F.col("event_id").alias("_old"), "seq"),
        ["duplicate_of_post_id"],
        ["seq"],
    ).drop("seq")
    return (
        decisions.filter("action = 'DUPLICATE'")
        .select("batch_id", "duplicate_of_post_id", F.explode("post_ids").alias("post_id"))
        .join(in_batch, ["batch_id", "duplicate_of_post_id"], "left")
        .join(latest, "duplicate_of_post_id", "left")
        .select("batch_id", "post_id", F.coalesce("_batch", "_old").alias("event_id"))
    )


def duplicate_pairs(decisions: DataFrame) -> DataFrame:
    """(post, duplicate of) pairs, each once."""
    pairs = decisions.filter("action = 'DUPLICATE'").select(
        F.explode("post_ids").alias("post_id"), "duplicate_of_post_id", F.col("confidence").alias("similarity_score"), "batch_id"
    )
    return first_per_key(pairs, ["post_id", "duplicate_of_post_id"], ["batch_id", "similarity_score"])


def apply_outcome(resolved: DataFrame, pairs: DataFrame) -> DataFrame:
    """What a batch did."""
    done = resolved.groupBy("batch_id").agg(
        F.count_if((F.col("action") == "NEW_EVENT") & F.col("created")).alias("new_events"),
        F.count_if(F.col("action").isin("MATCH_EXISTING_EVENT", "UPDATE_EXISTING_EVENT")).alias("existing_matches"),
        F.count_if(F.col("action") == "UNCERTAIN").alias("uncertain"),
        F.count_distinct("target_event_id").alias("affected_events"),
    )
    copies = pairs.groupBy("batch_id").agg(F.count("*").alias("duplicates"))
    return done.join(copies, "batch_id", "left").fillna(0, ["duplicates"])
