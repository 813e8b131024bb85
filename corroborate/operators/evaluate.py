"""Evaluation: decisions against history, model benchmarks, run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.config import ACTIONS, LIMITS
from corroborate.functions.text import has_latin, has_persian, review_tokens
from corroborate.functions.timefn import round_half_up
from corroborate.operators.blocks import first_per_key, last_per_key, top_per_key
from corroborate.operators.ops import latency_summary

DECISION_KEYS = (
    "post_ids", "action", "event_id", "duplicate_of_post_id",
    "confidence", "canonical_fact", "category", "reason",
)


def predicted_group() -> Column:
    """Group a decision puts its posts into."""
    name = F.coalesce(F.col("event_id").cast("string"), F.concat(F.lit("new:"), F.col("decision_no").cast("string")))
    return F.concat("action", F.lit(":"), name)


def decision_members(decisions: DataFrame) -> DataFrame:
    return decisions.select(
        "batch_id", "decision_no", predicted_group().alias("predicted_group"), F.explode("post_ids").alias("post_id")
    )


def last_groups(decisions: DataFrame) -> DataFrame:
    """Group of every post (batch_id, post_id); the last decision that names it counts."""
    members = decision_members(decisions)
    return last_per_key(members, ["batch_id", "post_id"], ["decision_no"]).select("batch_id", "post_id", "predicted_group")


def agreement(decisions: DataFrame, history: DataFrame) -> DataFrame:
    """Every decision compared with the stored events of its posts.

    Only the smallest and largest event and a membership flag are needed, so a
    decision over very many rows is reduced map-side. ``history`` has
    (post_id, event_id).
    """
    known = history.select("post_id", F.col("event_id").alias("_event"))
    facts = (
        decisions.select("batch_id", "decision_no", F.col("event_id").alias("_target"), F.explode("post_ids").alias("post_id"))
        .join(known, "post_id")
        .groupBy("batch_id", "decision_no")
        .agg(
            F.min("_event").alias("_low"),
            F.max("_event").alias("_high"),
            F.bool_or(F.coalesce(F.col("_event") == F.col("_target"), F.lit(False))).alias("_hit"),
        )
    )
    action = F.col("action")
    linked = action.isin("MATCH_EXISTING_EVENT", "UPDATE_EXISTING_EVENT")
    one = F.col("_low").isNotNull() & (F.col("_low") == F.col("_high"))
    many = F.coalesce(F.col("_low") != F.col("_high"), F.lit(False))
    sure = ~((action == "UNCERTAIN") | (F.col("confidence") < LIMITS.ambiguity))
    existing = linked & one & F.coalesce(F.col("_hit"), F.lit(False))
    copied = (action == "DUPLICATE") & one
    new = (action == "NEW_EVENT") & ~many
    agrees = existing | copied | new
    judged = linked | action.isin("DUPLICATE", "NOISE")
    return (
        decisions.join(facts, ["batch_id", "decision_no"], "left")
        .withColumn("new_agreement", sure & new)
        .withColumn("existing_agreement", sure & (existing | copied) & ~new)
        .withColumn("disagreement", sure & ~agrees & judged)
        .withColumn("false_merge", sure & many)
        .drop("_low", "_high", "_hit")
    )


def agreement_totals(compared: DataFrame) -> DataFrame:
    """Counts over all decisions, and the agreement rate."""
    totals = compared.agg(
        F.count_if("existing_agreement").alias("existing_event_agreements"),
        F.count_if("new_agreement").alias("new_event_agreements"),
        (F.count_if("disagreement") + F.count_if("false_merge")).alias("disagreements"),
        F.count_if("false_merge").alias("false_merge_candidates"),
    )
    pairs = F.col("existing_event_agreements") + F.col("disagreements")
    return totals.withColumn(
        "agreement_rate", round_half_up(F.col("existing_event_agreements") / F.nullif(pairs, F.lit(0)), 4)
    )


def false_splits(batch_posts: DataFrame, decisions: DataFrame, history: DataFrame) -> DataFrame:
    """Stored events whose posts of one batch fell into several groups.

    Of several decisions on a post the last counts. Posts no decision covers
    form a group of their own.
    """
    posts = batch_posts.select("batch_id", "post_id").join(last_groups(decisions), ["batch_id", "post_id"], "left")
    joined = posts.join(history, "post_id").groupBy("batch_id", "event_id", "predicted_group").agg(F.count("*").alias("_n"))
    return (
        joined.groupBy("batch_id", "event_id")
        .agg(F.count("*").alias("groups"), F.sum("_n").alias("posts"))
        .filter("groups > 1")
    )


def cross_language_pairs(batch_posts: DataFrame, history: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pairs of one batch that share a stored event across scripts.

    Posts in Persian script meet posts in Latin script on (batch, event);
    texts stay behind. A batch is packed to a few dozen posts, which bounds the
    pairs. ``batch_posts`` has batch_id, post_id and text.
    """
    script = [has_persian(F.col("text")).alias("_fa"), has_latin(F.col("text")).alias("_la")]
    posts = batch_posts.select("batch_id", "post_id", *script).filter("_fa or _la")
    rows = posts.join(history, "post_id").join(last_groups(decisions), ["batch_id", "post_id"], "left")
    key = ["batch_id", "event_id"]
    left = rows.filter("_fa").select(*key, F.col("post_id").alias("_a"), F.col("predicted_group").alias("_ag"))
    right = rows.filter("_la").select(*key, F.col("post_id").alias("_b"), F.col("predicted_group").alias("_bg"))
    return (
        left.join(right, key)
        .filter("_a <> _b")
        .select(
            "batch_id",
            F.least("_a", "_b").alias("left_post_id"),
            F.greatest("_a", "_b").alias("right_post_id"),
            F.when(F.col("_ag").eqNullSafe(F.col("_bg")), F.lit("grouped")).otherwise(F.lit("separated")).alias("result"),
        )
        .distinct()
    )


def copied_source_cases(reports: DataFrame) -> DataFrame:
    """Events reported by more sources than they have origins.

    ``reports`` has batch_id, event_id, source_id and origin_group. Pairs are
    made distinct first, so repeated reports never travel.
    """
    key = ["batch_id", "event_id"]
    sources = reports.select(*key, "source_id").distinct().groupBy(*key).agg(F.count("*").alias("sources"))
    origins = reports.select(*key, "origin_group").distinct().groupBy(*key).agg(F.count("origin_group").alias("origins"))
    return sources.join(origins, key).filter("sources >= 2 and origins > 0 and origins < sources")


def shared_terms(members: DataFrame, k: int = 12) -> DataFrame:
    """The first ``k`` terms (alphabetical) that all texts of a group share.

    ``members`` has group_id, post_id and text. A term is shared if as many
    posts hold it as the group has; terms are counted with partial
    aggregation. Groups of one post share nothing.
    """
    sizes = members.groupBy("group_id").agg(F.count_distinct("post_id").alias("_size")).filter("_size > 1")
    terms = members.select("group_id", F.explode(review_tokens(F.col("text"))).alias("term"))
    counted = terms.groupBy("group_id", "term").agg(F.count("*").alias("_holders"))
    common = counted.join(sizes, "group_id").filter("_holders = _size").select("group_id", "term")
    return top_per_key(common, ["group_id"], ["term"], k, "term_no")


def span_hours(members: DataFrame) -> DataFrame:
    """Hours between the first and the last post of a group."""
    hours = (F.unix_micros(F.max("seen_at")) - F.unix_micros(F.min("seen_at"))) / F.lit(3_600_000_000.0)
    return members.groupBy("group_id").agg(round_half_up(hours, 3).alias("span_hours"))


def review_samples(cases: DataFrame, limits: dict[str, int], default: int = 10) -> DataFrame:
    """the first cases of every review category, in batch order."""
    caps = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    most = max([default, *limits.values()])
    ranked = top_per_key(cases, ["category"], ["batch_id", "case_key"], most, "sample_no")
    return ranked.filter(F.col("sample_no") <= F.coalesce(F.try_element_at(caps, F.col("category")), F.lit(default)))


def rejected_responses(calls: DataFrame) -> DataFrame:
    """Rejected responses by code."""
    return calls.filter("rejection_code is not null").groupBy("rejection_code").agg(F.count("*").alias("responses"))


def run_metrics(attempts: DataFrame) -> DataFrame:
    """Success rates and retry recoveries over logical requests.

    ``attempts`` has request_id, kind, attempt (1-based), status and
    structured. First and last attempts are order statistics.
    """
    won = F.col("structured") & F.coalesce(F.col("status").between(200, 299), F.lit(False))
    requests = (
        attempts.withColumn("_won", won)
        .groupBy("request_id", "kind")
        .agg(
            F.min_by(F.struct("_won", "status"), "attempt").alias("_first"),
            F.max_by("_won", "attempt").alias("_last_won"),
            F.count("*").alias("_n"),
        )
    )
    primary = F.col("kind") == "primary"
    retried = F.col("_n") > 1
    totals = requests.agg(
        F.count("*").alias("logical_requests"),
        F.count_if(primary).alias("initial_requests"),
        F.count_if(primary & F.col("_first._won")).alias("initial_successes"),
        F.count_if(primary & ~F.col("_first._won")).alias("initial_failures"),
        F.count_if(primary & (F.col("_first.status") == 502)).alias("initial_http_502"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("retry_calls"),
        F.count_if(retried & F.col("_last_won")).alias("retry_successes"),
        F.count_if(retried & ~F.col("_last_won")).alias("retry_failures"),
    )
    rate = F.col("initial_successes") / F.nullif(F.col("initial_requests"), F.lit(0))
    return totals.withColumn("initial_success_rate", round_half_up(rate, 4))


def benchmark_summary(samples: DataFrame) -> DataFrame:
    """Request, validity and latency figures per model."""
    counts = samples.groupBy("model").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status") == 200).alias("http"),
        F.count_if("json_valid").alias("json"),
        F.count_if("schema_valid").alias("schema_ok"),
        F.count_if("contract_valid").alias("contract_ok"),
        F.count_if(F.col("contract_valid") & (F.col("missing_posts") == 0)).alias("full_coverage"),
        round_half_up(F.sum("completion_tokens") / F.nullif(F.count("completion_tokens"), F.lit(0)), 2).alias(
            "average_completion_tokens"
        ),
    )
    spread = latency_summary(samples, ["model"]).select("model", F.col("p50").alias("median_latency_ms"), F.col("p95").alias("p95_latency_ms"), F.col("maximum").alias("max_latency_ms"))
    return counts.join(spread, "model", "left")


def histogram(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts of a label per key, as rows."""
    return samples.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("samples"))


def ceiling_summary(samples: DataFrame) -> DataFrame:
    """Outcome of every token ceiling, and whether it was fully reliable."""
    status = F.col("status")
    return (
        samples.groupBy("max_tokens")
        .agg(
            F.count("*").alias("requests"),
            F.count_if(status.between(200, 299)).alias("http_success"),
            F.count_if("schema_valid").alias("schema_ok"),
            F.count_if(status == 502).alias("terminal_502"),
            F.count_if(status.between(500, 599)).alias("terminal_5xx"),
            F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("total_completion_tokens"),
        )
        .withColumn(
            "reliable", (F.col("http_success") == F.col("requests")) & (F.col("schema_ok") == F.col("requests"))
        )
    )


def smallest_reliable(ceilings: DataFrame) -> DataFrame:
    """The smallest fully reliable ceiling, null if there is none."""
    return ceilings.agg(F.min(F.when(F.col("reliable"), F.col("max_tokens"))).alias("max_tokens"))


def contract_audit(responses: DataFrame) -> DataFrame:
    """Missing, extra and mistyped keys over all decisions of the responses.

    ``responses`` has response_id and output, a JSON object with a decisions
    array. Returns (kind, key, decisions) counts.
    """
    listed = F.from_json(F.to_json(F.try_variant_get(F.try_parse_json("output"), "$.decisions", "variant")), "array<variant>")
    decisions = responses.select("response_id", F.posexplode(listed).alias("no", "v"))
    fields = F.from_json(F.to_json("v"), "map<string,variant>")
    is_map = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    rows = decisions.withColumn("f", F.when(is_map, fields).otherwise(F.create_map().cast("map<string,variant>")))
    expected = F.array(*[F.lit(k) for k in DECISION_KEYS])
    have = F.map_keys("f")

    def kind_of(v: Column) -> Column:
        shape = F.schema_of_variant(v)
        return (
            F.when(v.isNull() | (shape == "VOID"), F.lit("null"))
            .when(shape.startswith("ARRAY"), F.lit("array"))
            .when(shape.startswith("OBJECT"), F.lit("object"))
            .when(shape == "STRING", F.lit("string"))
            .when(shape == "BOOLEAN", F.lit("boolean"))
            .otherwise(F.lit("number"))
        )

    def wrong(key: str) -> Column:
        kind = kind_of(F.try_element_at(F.col("f"), F.lit(key)))
        if key == "post_ids":
            ok = kind == "array"
        elif key in ("event_id", "duplicate_of_post_id"):
            ok = kind.isin("number", "null")
        else:
            ok = kind == ("number" if key == "confidence" else "string")
        return F.when(F.array_contains(have, key) & ~ok, F.concat(F.lit(f"{key}:"), kind))

    missing, extra = F.array_except(expected, have), F.array_except(have, expected)
    complete = F.when((F.size(missing) == 0) & (F.size(extra) == 0), F.lit("complete"))
    action = F.try_variant_get(F.try_element_at(F.col("f"), F.lit("action")), "$", "string")
    action_kind = kind_of(F.try_element_at(F.col("f"), F.lit("action")))

    def tagged(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    findings = F.concat(
        tagged("missing", missing),
        tagged("extra", extra),
        tagged("wrong_type", F.array_compact(F.array(*[wrong(k) for k in DECISION_KEYS]))),
        tagged("shape", F.array_compact(F.array(complete))),
        tagged("action", F.array(F.when(action_kind == "string", action).otherwise(F.lit("[invalid/missing]")))),
    )
    return rows.select(F.explode(findings).alias("x")).groupBy("x.kind", "x.key").agg(F.count("*").alias("decisions"))
