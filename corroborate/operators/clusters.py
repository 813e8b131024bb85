"""From proposed partitions and judged pairs to event clusters.

A proposal is a partition of one batch made elsewhere; it is checked against
its contract, falls back to singletons when the contract is broken, and is
then rebuilt from the pairs that were judged to be the same event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.config import CLASSIFICATIONS, LIMITS
from corroborate.functions.places import explicit_places, places_contradict
from corroborate.functions.text import first_non_empty, infer_category
from corroborate.session import compute_once

# --- fixed values -----------------------------------------------------------
INVALID = "current_window_proposal_invalid"
UNKNOWN = "current_window_unknown_post_id"
REPEATED = "current_window_duplicate_post_assignment"
MISSING = "current_window_missing_post_assignment"
SHAPE_FAILURE = "CURRENT_WINDOW_INVALID_CLUSTER_SHAPE"
SCHEMA_FAILURE = "CURRENT_WINDOW_SCHEMA_FAILURE"
FAILURE_CLASSES = {
    INVALID: SHAPE_FAILURE,
    UNKNOWN: "CURRENT_WINDOW_UNKNOWN_POST_ID",
    REPEATED: "CURRENT_WINDOW_DUPLICATE_POST_ASSIGNMENT",
    MISSING: "CURRENT_WINDOW_MISSING_POST_ASSIGNMENT",
}
CLUSTERED = "AI_CLUSTERING"
FAIL_CLOSED = "FAIL_CLOSED_SINGLETON_FALLBACK"
# ----------------------------------------------------------------------------


def _cluster_shape_ok(max_posts: int) -> Column:
    ids = F.col("post_ids")
    ok = (
        F.size(ids).between(1, max_posts)
        & F.forall(ids, lambda x: F.coalesce(x > 0, F.lit(False)))
        & F.col("classification").isin(*CLASSIFICATIONS)
        & F.col("confidence").between(0.0, 1.0)
    )
    return F.coalesce(ok, F.lit(False))


def _verdicts(answers: DataFrame, batch_posts: DataFrame, names: tuple[str, ...], max_posts: int) -> DataFrame:
    """One row for every batch and answer (column ``_answer``) with its code and offending ids.

    Clusters, their members and the posts of the batch are laid one under the
    other and dealt out by batch once; every later step groups by more columns
    than that, so nothing is shuffled again. Answers of wrong shape are not
    exploded, so at most 40 x 40 ids of an answer take part.
    """
    shapely = answers.withColumn("_ok", _cluster_shape_ok(max_posts))
    key = ["batch_id", "_answer"]
    none = F.lit(None).cast("bigint")
    place = F.struct(F.col("cluster_no").cast("bigint").alias("cluster_no"), F.col("pos").cast("bigint").alias("pos"))
    shapes = shapely.select(*key, none.alias("post_id"), F.lit(None).cast(PLACE).alias("place"), "_ok", F.lit(False).alias("_expected"))
    members = shapely.filter("_ok").select(*key, "cluster_no", F.posexplode("post_ids").alias("pos", "post_id"))
    members = members.select(*key, "post_id", place.alias("place"), F.lit(None).cast("boolean").alias("_ok"), F.lit(False).alias("_expected"))
    expected = batch_posts.select(
        "batch_id", F.explode(F.array(*map(F.lit, names))).alias("_answer"), "post_id", F.lit(None).cast(PLACE).alias("place"),
        F.lit(None).cast("boolean").alias("_ok"), F.lit(True).alias("_expected"),
    )
    rows = shapes.unionByName(members).unionByName(expected).repartition("batch_id")
    places = F.sort_array(F.collect_list("place"))
    posts = rows.groupBy(*key, "post_id").agg(
        F.bool_and("_ok").alias("_ok"), F.count("_ok").alias("_clusters"), F.bool_or("_expected").alias("_expected"), places.alias("_places")
    )
    code = F.when(~F.col("_expected"), F.lit(UNKNOWN)).when(F.size("_places") > 1, F.lit(REPEATED))
    at = F.when(F.col("_expected"), F.get("_places", F.lit(1))).otherwise(F.get("_places", F.lit(0)))
    fault = F.when(F.col("post_id").isNotNull() & code.isNotNull(), F.struct(at.alias("at"), code.alias("code"), "post_id"))
    missing = F.when(F.col("post_id").isNotNull() & F.col("_expected") & (F.size("_places") == 0), F.col("post_id"))
    found = posts.groupBy(*key).agg(
        F.coalesce(F.bool_and("_ok") & (F.sum("_clusters") <= max_posts), F.lit(False)).alias("_shaped"),
        F.sum("_clusters").alias("_clusters"),
        F.min(fault).alias("_first"),
        F.sort_array(F.collect_set(missing)).alias("_missing"),
    )
    return found.filter("_clusters > 0").select(
        *key,
        F.when(~F.col("_shaped"), F.lit(INVALID))
        .when(F.col("_first").isNotNull(), F.col("_first.code"))
        .when(F.size("_missing") > 0, F.lit(MISSING))
        .alias("code"),
        F.when(~F.col("_shaped"), F.array().cast("array<bigint>"))
        .when(F.col("_first").isNotNull(), F.array("_first.post_id"))
        .otherwise(F.col("_missing"))
        .alias("offending_post_ids"),
    )


PLACE = "struct<cluster_no:bigint,pos:bigint>"


def validate_proposals(
    proposals: DataFrame, batch_posts: DataFrame, max_posts: int = LIMITS.cluster_posts
) -> DataFrame:
    """One verdict per proposed batch: ``code`` (null if valid), its failure
    class and the offending ids.

    Shape errors come first, then the first unknown or repeated id in proposal
    order, then missing ids.
    """
    classes = F.create_map(*[F.lit(x) for pair in FAILURE_CLASSES.items() for x in pair])
    verdicts = _verdicts(proposals.withColumn("_answer", F.lit("first")), batch_posts, ("first",), max_posts)
    return verdicts.drop("_answer").withColumn("failure_class", F.try_element_at(classes, F.col("code")))


def validate_answers(
    asked: DataFrame, proposals: DataFrame, batch_posts: DataFrame, max_posts: int = LIMITS.cluster_posts
) -> DataFrame:
    """I1 for every batch that was asked (batch_id, parsed), with or without clusters in its answer.

    ``parsed`` is false if the answer was no object with a list of clusters:
    a schema failure. An empty list, or clusters of wrong shape, fail by shape.
    """
    found = validate_proposals(proposals, batch_posts, max_posts).withColumn("_any", F.lit(True))
    joined = asked.select("batch_id", "parsed").join(found, "batch_id", "left")
    nothing = ~F.coalesce("parsed", F.lit(False)) | F.col("_any").isNull()
    code = F.when(nothing, F.lit(INVALID)).otherwise(F.col("code"))
    kind = (
        F.when(~F.coalesce("parsed", F.lit(False)), F.lit(SCHEMA_FAILURE))
        .when(code == INVALID, F.lit(SHAPE_FAILURE))
        .otherwise(F.col("failure_class"))
    )
    offending = F.when(nothing, F.array().cast("array<bigint>")).otherwise(F.col("offending_post_ids"))
    return joined.select("batch_id", code.alias("code"), offending.alias("offending_post_ids"), kind.alias("failure_class"))


def resolve_proposals(
    first: DataFrame, correction: DataFrame, batch_posts: DataFrame, asked: DataFrame | None = None
) -> DataFrame:
    """The partition to use for every batch that got a first answer, empty or unreadable ones (named by ``asked``) included.

    A valid first answer wins, then a valid correction; else every post becomes
    an uncertain singleton with confidence 0. Batches without a first answer do
    not appear: they stay pending. Everything is keyed by batch: what is
    checked and what may be kept are each dealt out by batch once.
    """
    answers = first.withColumn("_answer", F.lit("first")).unionByName(
        correction.select(*first.columns).withColumn("_answer", F.lit("second"))
    )
    verdicts = _verdicts(answers, batch_posts, ("first", "second"), LIMITS.cluster_posts)
    valid = F.col("code").isNull()
    choice = verdicts.groupBy("batch_id").agg(
        F.bool_or(F.col("_answer") == "first").alias("_asked"),
        F.coalesce(F.min(F.when(valid, F.col("_answer"))), F.lit("neither")).alias("_choice"),
    )
    if asked is None:
        choice = choice.filter("_asked")
    else:
        choice = asked.select("batch_id").distinct().join(choice, "batch_id", "left")
        choice = choice.withColumn("_choice", F.coalesce("_choice", F.lit("neither")))
    offered = answers.select(
        "batch_id",
        "_answer",
        F.col("cluster_no").cast("bigint").alias("cluster_no"),
        F.sort_array("post_ids").alias("post_ids"),
        "classification",
        "confidence",
        F.lit(CLUSTERED).alias("processing_mode"),
    )
    singles = batch_posts.select(
        "batch_id",
        F.lit("neither").alias("_answer"),
        F.col("post_id").alias("cluster_no"),
        F.array("post_id").alias("post_ids"),
        F.lit("UNCERTAIN").alias("classification"),
        F.lit(0.0).alias("confidence"),
        F.lit(FAIL_CLOSED).alias("processing_mode"),
    )
    candidates = offered.unionByName(singles).repartition("batch_id")
    return candidates.join(choice, "batch_id").filter("_answer = _choice").drop("_answer", "_choice", "_asked")


def proposed_pairs(clusters: DataFrame) -> DataFrame:
    """Unordered pairs inside each proposed EVENT cluster.

    The contract bounds a cluster to 40 ids, so the pairs are made inside the
    row, without a self-join.
    """
    ids = F.col("post_ids")
    pairs = F.flatten(
        F.transform(
            ids,
            lambda left, i: F.transform(
                F.filter(ids, lambda _, j: j > i),
                lambda right: F.struct(left.alias("left_post_id"), right.alias("right_post_id")),
            ),
        )
    )
    events = clusters.filter((F.col("classification") == "EVENT") & (F.size("post_ids") >= 2))
    return events.select("batch_id", "cluster_no", F.explode(pairs).alias("p")).select(
        "batch_id", "cluster_no", "p.left_post_id", "p.right_post_id"
    )


def accepts_pair(relationship: Column, confidence: Column, threshold: float = LIMITS.pair_confidence) -> Column:
    """Same event, confidently; a missing judgment fails."""
    return F.coalesce((relationship == "SAME_EVENT") & (confidence >= threshold), F.lit(False))


def judge_pairs(pairs: DataFrame, judgments: DataFrame) -> DataFrame:
    """Pairs with their judgment, if any, and whether it is accepted."""
    key = ["batch_id", "left_post_id", "right_post_id"]
    return pairs.join(judgments.select(*key, "relationship", "confidence"), key, "left").withColumn(
        "accepted", accepts_pair(F.col("relationship"), F.col("confidence"))
    )


def veto_pairs(judged: DataFrame, posts: DataFrame) -> DataFrame:
    """Accepted pairs whose explicit places contradict are vetoed.

    Places are found once per post, and only for posts of accepted pairs; both
    sides of a pair then meet by aggregation.
    """
    key = ["left_post_id", "right_post_id"]
    accepted = judged.filter("accepted").select(*key).distinct()
    sides = accepted.select(*key, F.explode(F.array(*key)).alias("post_id"))
    text = first_non_empty(F.col("normalized_text"), F.col("original_text"))
    texts = posts.join(sides.select("post_id"), "post_id", "left_semi").select("post_id", text.alias("text"))
    places = compute_once(texts, "places", explicit_places(F.col("text"))).filter(F.size("places") > 0)

    def side(name: str) -> Column:
        return F.max(F.when(F.col("post_id") == F.col(name), F.col("places")))

    vetoed = (
        sides.join(places, "post_id")
        .groupBy(*key)
        .agg(side("left_post_id").alias("_left"), side("right_post_id").alias("_right"))
        .filter(places_contradict(F.col("_left"), F.col("_right")))
        .select(*key, F.lit(True).alias("_vetoed"))
    )
    return (
        judged.join(vetoed, ["left_post_id", "right_post_id"], "left")
        .withColumn("vetoed", F.coalesce("_vetoed", F.lit(False)) & F.col("accepted"))
        .withColumn("usable", F.col("accepted") & ~F.col("vetoed"))
        .drop("_vetoed")
    )


STAR_SCHEMA = (
    "batch_id bigint, cluster_no bigint, post_ids array<bigint>, classification string, "
    "confidence double, anchor_post_id bigint, edge_count int"
)


def stars(post_ids, edges) -> list[tuple[list[int], int, list[float]]]:
    """Split one cluster into stars: (members, anchor, edge confidences).

    The anchor is the remaining post with the most usable edges, then the
    larger confidence sum, then the smaller id; it takes its direct neighbours
    only.
    """
    left = set(post_ids)
    out = []
    while left:
        alive = [e for e in edges if e[0] in left and e[1] in left]
        degree = dict.fromkeys(left, 0)
        weight = dict.fromkeys(left, 0.0)
        for a, b, confidence in alive:
            for post in (a, b):
                degree[post] += 1
                weight[post] += confidence
        anchor = min(left, key=lambda p: (-degree[p], -weight[p], p))
        mine = [e for e in alive if anchor in e[:2]]
        members = sorted({anchor, *(e[0] for e in mine), *(e[1] for e in mine)})
        out.append((members, anchor, [e[2] for e in mine]))
        left.difference_update(members)
    return out


def _star_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in STAR_SCHEMA.split(", ")]
    for frame in frames:
        rows = []
        for r in frame.itertuples(index=False):
            edges = [(e["left_post_id"], e["right_post_id"], e["confidence"]) for e in r.edges]
            for members, anchor, confidences in stars(list(r.post_ids), edges):
                rows.append(
                    (r.batch_id, r.cluster_no, members, r.classification, min([r.confidence, *confidences]), anchor, len(confidences))
                )
        yield pd.DataFrame(rows, columns=columns)


def star_clusters(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """I4: rebuild each proposed cluster from its usable pairs.

    Clusters that need no pairs are split by ``explode`` in the JVM. The others
    meet their edges in one row (at most 780 by contract) and are split by a
    small fold, Arrow batch by Arrow batch.
    """
    paired = (F.col("classification") == "EVENT") & (F.size("post_ids") >= 2)
    single = (
        clusters.filter(~paired)
        .withColumn("post_id", F.explode("post_ids"))
        .select(
            "batch_id",
            F.col("cluster_no").cast("bigint").alias("cluster_no"),
            F.array("post_id").alias("post_ids"),
            "classification",
            "confidence",
            F.col("post_id").alias("anchor_post_id"),
            F.lit(0).alias("edge_count"),
        )
    )
    edges = (
        pairs.filter("usable")
        .groupBy("batch_id", "cluster_no")
        .agg(F.array_sort(F.collect_list(F.struct("left_post_id", "right_post_id", "confidence"))).alias("edges"))
    )
    no_edges = F.array().cast("array<struct<left_post_id:bigint,right_post_id:bigint,confidence:double>>")
    joined = (
        clusters.filter(paired)
        .join(edges, ["batch_id", "cluster_no"], "left")
        .select(
            "batch_id", F.col("cluster_no").cast("bigint").alias("cluster_no"), "post_ids", "classification",
            "confidence", F.coalesce("edges", no_edges).alias("edges"),
        )
    )
    return single.unionByName(joined.mapInPandas(_star_rows, STAR_SCHEMA))


def edge_stats(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pair and cluster counters per batch."""
    edges = pairs.groupBy("batch_id").agg(
        F.count("*").alias("pair_checks"),
        F.count_if("accepted").alias("raw_same_event_edges"),
        F.count_if("usable").alias("accepted_same_event_edges"),
        F.count_if("vetoed").alias("hard_contradiction_vetoes"),
        F.count_if(~F.col("usable")).alias("rejected_edges"),
    )
    sizes = clusters.groupBy("batch_id").agg(
        F.count_if(F.size("post_ids") > 1).alias("final_multi_report_clusters"),
        F.count_if(F.size("post_ids") == 1).alias("final_singletons"),
    )
    counters = [c for c in edges.columns if c != "batch_id"]
    return sizes.join(edges, "batch_id", "left").fillna(0, counters)


def decisions_from_clusters(clusters: DataFrame, posts: DataFrame) -> DataFrame:
    """The decision each cluster stands for; its first post gives the fact."""
    texts = posts.select(
        F.col("post_id").alias("_first"),
        first_non_empty(F.col("normalized_text"), F.col("original_text")).alias("_text"),
    )
    text = F.coalesce("_text", F.lit("Current-window report"))
    kind = F.col("classification")
    return (
        clusters.withColumn("_first", F.col("post_ids")[0])
        .join(texts, "_first", "left")
        .select(
            "batch_id",
            F.col("_first").alias("decision_no"),
            "post_ids",
            F.when(kind.isin("NOISE", "UNCERTAIN"), kind).otherwise(F.lit("NEW_EVENT")).alias("action"),
            F.lit(None).cast("bigint").alias("event_id"),
            F.lit(None).cast("bigint").alias("duplicate_of_post_id"),
            "confidence",
            F.substring(text, 1, LIMITS.fact_chars).alias("canonical_fact"),
            infer_category(text).alias("category"),
            F.when(
                kind == "EVENT",
                F.concat(F.lit("v8_current_window_anchor_cluster:"), F.col("anchor_post_id").cast("string")),
            )
            .otherwise(F.concat(F.lit("v8_current_window_"), F.lower(kind)))
            .alias("reason"),
        )
    )


def judgments_from(pairs: DataFrame, posts: DataFrame, scorer, prepared=None) -> DataFrame:
    """K1: judgments made by a user function instead of read from a table.

    ``scorer(left, right)`` is any column function of two texts, for instance a
    ``pandas_udf``, giving a struct of relationship and confidence. Where a
    text has to be worked on first, ``prepared`` is a column function of one
    text and the scorer gets its values: it is computed once for each post.
    Pairs (batch_id, cluster_no, left_post_id, right_post_id) are bounded by
    the cluster contract, so scoring is linear in the posts. A post travels
    once to its cluster, not once for each of its pairs.
    """
    text = first_non_empty(F.col("normalized_text"), F.col("original_text"))
    key = ["batch_id", "cluster_no"]
    wanted = pairs.select(*key, F.explode(F.array("left_post_id", "right_post_id")).alias("post_id")).distinct()
    values = compute_once(posts.select("post_id", text.alias("_text")), "value", prepared(F.col("_text")) if prepared else F.col("_text"))
    members = wanted.join(values.drop("_text"), "post_id").groupBy(*key).agg(F.collect_list(F.struct("post_id", "value")).alias("_members"))
    asked = pairs.groupBy(*key).agg(F.collect_list(F.struct("left_post_id", "right_post_id")).alias("_pairs"))

    def side(pair: Column, name: str) -> Column:
        return F.filter("_members", lambda m: m["post_id"] == pair[name])

    met = F.transform(
        "_pairs",
        lambda p: F.flatten(
            F.transform(
                side(p, "left_post_id"),
                lambda a: F.transform(
                    side(p, "right_post_id"),
                    lambda b: F.struct(a["post_id"].alias("left_post_id"), b["post_id"].alias("right_post_id"), a["value"].alias("_left"), b["value"].alias("_right")),
                ),
            )
        ),
    )
    scored = asked.join(members, key).select("batch_id", F.explode(F.flatten(met)).alias("p")).select("batch_id", "p.*")
    scored = compute_once(scored, "_judged", scorer(F.col("_left"), F.col("_right")))
    return scored.select("batch_id", "left_post_id", "right_post_id", "_judged.relationship", "_judged.confidence")
