"""Copy lineage in the flagship, decisions that cover a post twice, and inputs that must be refused."""

import pytest
from pyspark.sql import functions as F

from corroborate.catalog.event_queries import _copied
from corroborate.catalog.views import Views
from corroborate.operators import evaluate as E
from corroborate.operators import evidence as V
from corroborate.operators.batches import density_groups
from corroborate.operators.shortlist import newest_events

FOLDER = "/root/testdata/sf0.001"


def test_copies_change_a_verification_status(spark):
    rows, copies = _copied(Views(spark, FOLDER), Views(spark, FOLDER).links)
    assert copies.count() > 0
    with_copies = V.verify_events(V.origin_groups(V.propagate_origins(rows, copies)))
    without = V.verify_events(V.origin_groups(V.own_origins(rows)))
    changed = with_copies.alias("a").join(without.alias("b"), "event_id").filter(
        "a.independent_confirmation_count < b.independent_confirmation_count"
    )
    assert changed.count() > 0


def decisions(spark, rows):
    return spark.createDataFrame(rows, "batch_id long, decision_no long, action string, event_id long, post_ids array<long>")


def test_uncovered_posts_are_a_group_of_their_own(spark):
    batch = spark.createDataFrame([(1, p, "t") for p in (1, 2, 3)], "batch_id long, post_id long, text string")
    history = spark.createDataFrame([(p, 50) for p in (1, 2, 3)], "post_id long, event_id long")
    made = decisions(spark, [(1, 0, "NEW_EVENT", None, [1])])
    assert [tuple(r) for r in E.false_splits(batch, made, history).collect()] == [(1, 50, 2, 3)]


def test_the_last_decision_on_a_post_counts(spark):
    batch = spark.createDataFrame([(1, 1, "abc"), (1, 2, "سلام")], "batch_id long, post_id long, text string")
    history = spark.createDataFrame([(1, 50), (2, 50)], "post_id long, event_id long")
    made = decisions(spark, [(1, 0, "NEW_EVENT", None, [1]), (1, 1, "NEW_EVENT", None, [1, 2])])
    assert E.false_splits(batch, made, history).count() == 0
    assert [r["result"] for r in E.cross_language_pairs(batch, history, made).collect()] == ["grouped"]


def test_too_few_posts_for_density_groups(spark):
    posts = spark.range(10).select(F.col("id").alias("post_id"), F.timestamp_seconds("id").alias("published_at"), F.timestamp_seconds("id").alias("observed_at"))
    with pytest.raises(Exception, match="fewer than 28 posts"):
        density_groups(posts).collect()


def test_short_shortlists_need_scores(spark):
    with pytest.raises(ValueError):
        newest_events(spark.range(1), spark.range(1), cap=10)


def test_copy_search_ends_at_the_latest_copy(spark, monkeypatch):
    """No set is compared with those before the copy that was found."""
    plain = V.set_overlap
    beyond = lambda a, b: F.array_contains(a, "late") & F.array_contains(b, "early")
    monkeypatch.setattr(V, "set_overlap", lambda a, b: F.when(beyond(a, b), F.raise_error(F.lit("compared")).cast("double")).otherwise(plain(a, b)))
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, n, n, f"{base} {extra}") for n, extra in ((1, "early"), (2, ""), (3, "late"))]
    evidence = spark.createDataFrame(rows, "event_id bigint, post_id bigint, at bigint, text string")
    found = V.copied_from(evidence.withColumn("attached_at", F.timestamp_seconds("at"))).collect()
    assert {(r.post_id, r.parent_post_id) for r in found} == {(2, 1), (3, 2)}


def test_tasks_do_not_grow_with_the_table(spark, monkeypatch):
    from corroborate import session

    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert session.spread(documents, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "PIECE_BYTES", 10_000)
    assert session.spread(documents, "doc_id").rdd.getNumPartitions() > 20
