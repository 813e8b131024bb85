import datetime as dt
import json
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corroborate.catalog.views import Views
from corroborate.operators import posts as P
from corroborate.sources import manifest as M
from corroborate.sources import pages as G
from corroborate.sources import registry as R
from corroborate.sources import sinks as S
from corroborate.session import shared_folder
from corroborate.sources import store as store_module
from corroborate.sources.store import PostStore
from corroborate.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)
FOLDER = "/root/testdata/sf0.001"
ENVELOPE = (
    "seq bigint, source_id bigint, message_id bigint, update_type string, canonical_url string, published_at timestamp, "
    "edited_at timestamp, observed_at timestamp, language string, text string, content_hash string, media_type string, "
    "raw_html_snippet string, metadata string"
)
STATE = (
    "canonical_url", "update_type", "published_at", "edited_at", "observed_at", "language", "original_text", "normalized_text",
    "content_hash", "media_type", "raw_html_snippet", "metadata", "is_deleted", "processing_status", "analysis_content_hash",
    "analysis_lease_at", "analysis_attempts",
)


def one_by_one(row, e):
    """Apply one envelope to a stored row the slow way."""
    text = e["text"]
    if row is None:
        return {
            **{c: e[c] for c in ("canonical_url", "update_type", "published_at", "edited_at", "observed_at", "language", "content_hash", "media_type", "raw_html_snippet", "metadata")},
            "original_text": text, "normalized_text": text.strip(), "is_deleted": e["update_type"] == "delete",
            "processing_status": "pending", "analysis_content_hash": None, "analysis_lease_at": None, "analysis_attempts": 0,
        }
    same = row["content_hash"] == e["content_hash"] and not row["is_deleted"] and e["update_type"] != "delete"
    out = dict(row)
    for c in ("canonical_url", "update_type", "observed_at", "language", "content_hash", "raw_html_snippet", "metadata"):
        out[c] = e[c]
    out["published_at"] = row["published_at"] or e["published_at"]
    out["media_type"] = e["media_type"] or row["media_type"]
    if e["update_type"] == "edit":
        out.update(edited_at=e["observed_at"], original_text=text, normalized_text=text.strip())
    if e["update_type"] == "delete":
        out["is_deleted"] = True
    if not same:
        out.update(processing_status="pending", analysis_content_hash=None, analysis_lease_at=None, analysis_attempts=0)
    return out


def test_envelope_log_against_a_one_by_one_fold(spark):
    rng = random.Random(11)
    stored, log, seq = {}, [], 0
    for key in range(120):
        if rng.random() < 0.5:
            first = {
                "canonical_url": "u0", "update_type": "create", "published_at": rng.choice([None, T0]), "edited_at": rng.choice([None, T0]),
                "observed_at": T0, "language": "fa", "original_text": "old", "normalized_text": "old", "content_hash": rng.choice("ab"),
                "media_type": rng.choice([None, "video"]), "raw_html_snippet": "s0", "metadata": "{}", "is_deleted": rng.random() < 0.2,
                "processing_status": "analyzed", "analysis_content_hash": "h", "analysis_lease_at": T0, "analysis_attempts": 3,
            }
            stored[key] = first
        for _ in range(rng.randint(0, 5)):
            seq += 1
            at = T0 + dt.timedelta(minutes=seq)
            kind = rng.choice(["create", "create", "edit", "edit", "delete"]) if rng.random() < 0.7 else "create"
            log.append(
                {
                    "seq": seq, "source_id": 1, "message_id": key, "update_type": kind, "canonical_url": f"u{seq}", "published_at": rng.choice([None, at]),
                    "edited_at": at if kind == "edit" else None, "observed_at": at, "language": "en", "text": f" t{seq} ", "content_hash": rng.choice("aab"),
                    "media_type": rng.choice([None, "photo"]), "raw_html_snippet": f"s{seq}", "metadata": f"m{seq}",
                }
            )
    expected = dict(stored)
    for e in log:
        expected[e["message_id"]] = one_by_one(expected.get(e["message_id"]), e)
    schema = Views(spark, FOLDER).stored_posts.schema
    rows = [{"source_id": 1, "message_id": k, "is_noise": False, "noise_reason": None, "created_at": T0, "updated_at": T0, **r} for k, r in stored.items()]
    current = spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema)
    rng.shuffle(log)
    envelopes = spark.createDataFrame([tuple(e[c.split()[0]] for c in ENVELOPE.split(", ")) for e in log], ENVELOPE)
    got = {r.message_id: {c: r[c] for c in STATE} for r in P.upsert_raw_posts(current, envelopes).collect()}
    assert got == {k: {c: r[c] for c in STATE} for k, r in expected.items()}


def page(spark, html, source_id=1):
    return spark.createDataFrame([(source_id, "key", "chan", "u", html, T0)], "source_id bigint, source_key string, username string, url string, html string, fetched_at timestamp")


def test_page_with_two_messages(spark):
    html = (
        '<div class="tgme_page_widget"><div data-post="chan/12"><div class="tgme_widget_message_text x">b &amp; c</div>'
        '<time datetime="2024-01-01T10:00:00+02:00"></time></div><div data-post="chan/0"></div>'
        '<div data-post="chan/11"><div class="tgme_widget_message_text">a<br>edited</div></div>'
    )
    rows = G.parse_pages(page(spark, html)).orderBy("message_id").collect()
    assert [(r.message_id, r.text, r.canonical_url) for r in rows] == [
        (11, "a\nedited", "https://t.me/chan/11"),
        (12, "b & c", "https://t.me/chan/12"),
    ]
    assert rows[1].published_at == dt.datetime(2024, 1, 1, 8) and rows[0].published_at is None
    assert rows[0].edited_at == T0 and rows[1].edited_at is None


@pytest.mark.parametrize("html, warning", [("<p>x</p>", "not_a_telegram_public_page"), ("tgme_page_widget", "page_has_no_message_markers")])
def test_page_warnings(spark, html, warning):
    assert G.page_warnings(page(spark, html)).first().warning == warning
    assert G.parse_pages(page(spark, html)).count() == 0


def test_page_cap_replaces_a_cut_character(spark):
    capped = G.cap_pages(page(spark, "a" * 63_999 + "ب" * 10), 1).first().html
    assert capped == "a" * 63_999 + "�"
    short = G.cap_pages(page(spark, "ب"), 70_000).first().html
    assert short == "ب"


def test_seeds_file_and_upsert(spark, tmp_path):
    seeds = [
        {"source_key": "k1", "name": "New", "telegram_username": "n", "role": "specialist", "priority_tier": "TIER_2", "category": "WORLD", "language": "en", "source_type": "press", "trust_score": 0.5, "is_wire_origin": False},
        {"source_key": "k2", "name": "Two", "telegram_username": "t", "role": "aggregator", "priority_tier": "TIER_3", "category": "IRAN", "language": "fa", "source_type": "press", "trust_score": 0.4, "is_wire_origin": True},
    ]
    (tmp_path / "seeds.json").write_text(json.dumps(seeds))
    loaded = R.read_seeds(spark, str(tmp_path / "seeds.json"))
    current = loaded.filter("source_key = 'k1'").withColumns(
        {"source_id": F.lit(7).cast("bigint"), "name": F.lit("Old"), "is_active": F.lit(True), "health_status": F.lit("healthy"), "last_seen_message_id": F.lit(9)}
    )
    rows = {r.source_key: r for r in R.upsert_sources(current, loaded).collect()}
    assert (rows["k1"].name, rows["k1"].is_active, rows["k1"].health_status, rows["k1"].last_seen_message_id) == ("New", True, "healthy", 9)
    assert (rows["k1"].source_id, rows["k2"].source_id) == (7, 8)
    assert (rows["k2"].is_active, rows["k2"].health_status, rows["k2"].last_seen_message_id) == (False, "pending_validation", None)


def test_manifest_file(spark, tmp_path):
    manifest = {
        "version": 1, "sample": "s", "start": "2024-01-01T00:00:00Z", "end": "2024-01-02T00:00:00Z", "post_ids": [1, 2, 3],
        "windows": [{"window_end": "2024-01-01T00:05:00Z", "post_ids": [2, 1]}, {"window_end": "2024-01-01T00:10:00Z", "post_ids": [3]}],
    }
    (tmp_path / "m.json").write_text(json.dumps(manifest, indent=1))
    entries = M.read_manifest(spark, str(tmp_path / "m.json"))
    posts = spark.createDataFrame([(1,), (2,), (3,)], "post_id bigint")
    assert M.check_manifest(entries, posts, 3).first().valid is True
    assert M.check_manifest(entries, posts.filter("post_id > 1"), 3).first().missing == 1


def test_diagnostics_are_json_by_window(spark, tmp_path):
    failed = spark.createDataFrame([(T0, "timeout", [1, 2])], "window_end timestamp, failure string, post_ids array<bigint>")
    S.write_diagnostics(failed, str(tmp_path / "d"))
    back = spark.read.json(str(tmp_path / "d")).first()
    assert (back.failure, back.post_ids) == ("timeout", [1, 2])


def test_streamed_pages_fold_to_the_same_posts_as_a_batch(spark, tmp_path):
    v = Views(spark, FOLDER)
    landing = str(tmp_path / "pages")
    v.channel_pages.repartition(3).write.parquet(landing)
    v.channel_pages.limit(5).write.mode("append").parquet(landing)  # polled twice
    page(spark, "<p>foreign</p>").write.mode("append").parquet(landing)
    for running in J.ingest_stream(J.page_stream(spark, landing, 2), v.sources, str(tmp_path / "out"), once=True):
        running.awaitTermination()
    log = spark.read.parquet(str(tmp_path / "out" / "envelopes"))
    assert spark.read.parquet(str(tmp_path / "out" / "quarantine")).count() == 1
    assert log.count() == v.raw_posts.count()
    empty = v.stored_posts.filter("false")
    columns = ["source_id", "message_id", "normalized_text", "is_noise", "processing_status", "content_hash"]
    streamed = J.fold_log(empty, log).select(*columns)
    parsed = G.parse_pages(v.channel_pages).withColumn("seq", F.lit(1))
    batch = J.fold_log(empty, G.to_envelopes(parsed, v.sources)).select(*columns)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_watermarked_dedupe(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a", T0), (1, 1, "a", T0), (1, 1, "b", T0)], "source_id bigint, message_id bigint, content_hash string, observed_at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    J._write(J.dedupe_stream(stream, "10 minutes"), str(tmp_path / "o"), str(tmp_path / "c"), True).awaitTermination()
    assert sorted(r.content_hash for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["a", "b"]


def test_admission_stream_counts_across_batches(spark, tmp_path):
    schema = "call_id bigint, ts timestamp, day string, stage string"
    for part in range(3):
        calls = [(part * 10 + i, T0 + dt.timedelta(seconds=part * 10 + i), "2024-01-01", "s") for i in range(4)]
        spark.createDataFrame(calls, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    J.admission_stream(stream, F.lit(6), str(tmp_path / "out"), once=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out" / "calls")).collect()
    assert len(rows) == 12 and sum(r.admitted for r in rows) == 6


def test_a_merge_reads_and_writes_touched_buckets_only(spark, tmp_path):
    v = Views(spark, FOLDER)
    store = PostStore(str(tmp_path / "store"), v.stored_posts.schema, buckets=16).create(v.stored_posts)
    before = store.heads(spark)
    one = v.envelopes.filter("seq = 5")
    (bucket,) = [r[0] for r in one.select(store.bucket()).collect()]
    plan = store.read(spark, [bucket])._jdf.queryExecution().optimizedPlan().toString()
    files = store.read(spark, [bucket]).inputFiles()
    assert files and all(f"/bucket={bucket}/" in f for f in files) and "Relation" in plan
    store.merge(one, 1)
    after = store.heads(spark)
    assert {b for b in after if after[b] != before.get(b)} == {bucket}
    assert store.read(spark).exceptAll(P.upsert_raw_posts(v.stored_posts, one)).count() == 0
    assert store.heads(spark, 1) == before


def test_a_broken_merge_leaves_the_store_and_can_be_repeated(spark, tmp_path, monkeypatch):
    v = Views(spark, FOLDER)
    store = PostStore(str(tmp_path / "store"), v.stored_posts.schema, buckets=4).create(v.stored_posts)
    log = v.envelopes.filter("seq < 200")
    with monkeypatch.context() as broken:
        broken.setattr(type(spark), "createDataFrame", lambda *a, **k: 1 / 0)  # after the rows, before the head
        with pytest.raises(ZeroDivisionError):
            store.merge(log, 1)
    assert store.read(spark).exceptAll(v.stored_posts).count() == 0
    store.merge(log, 1)
    store.merge(log, 1)  # a stream may run its last batch again
    expected = P.upsert_raw_posts(v.stored_posts, log)
    assert store.read(spark).exceptAll(expected).count() == 0 and store.read(spark).count() == expected.count()


@pytest.mark.parametrize("round_bytes", [1, 1 << 40])
def test_a_store_keeps_two_versions_and_no_step(spark, tmp_path, monkeypatch, round_bytes):
    """Older versions and the stored envelopes of each merge stayed on disk; rounds over buckets give the same rows."""
    monkeypatch.setattr(store_module, "ROUND_BYTES", round_bytes)
    shared = Path(shared_folder(spark).removeprefix("file:"))
    v = Views(spark, FOLDER)
    store = PostStore(str(tmp_path / "store"), v.stored_posts.schema, buckets=6)
    expected, steps = v.stored_posts.filter("false"), set(shared.glob("stored-*"))
    for version in (1, 2, 2, 3, 4):
        log = v.envelopes.filter(F.col("seq") % 4 == version - 1)
        store.merge(log, version)
        assert {p.name for p in (tmp_path / "store" / "rows").iterdir()} <= {f"version={n}" for n in (version - 1, version)}
    for version in (1, 2, 3, 4):
        expected = P.upsert_raw_posts(expected, v.envelopes.filter(F.col("seq") % 4 == version - 1))
    got = store.read(spark)
    assert got.exceptAll(expected).count() == 0 and got.count() == expected.count() > 0
    assert set(shared.glob("stored-*")) == steps
    store.forget(spark)
    assert [p.name for p in (tmp_path / "store" / "rows").iterdir()] == ["version=4"] and store.read(spark).count() == got.count()


def test_clean_texts_that_are_trimmed_texts_are_written_once(spark, tmp_path):
    v = Views(spark, FOLDER)
    texts = {1: (" a ", "a"), 2: (" a ", "b"), 3: ("a", None), 4: (None, None), 5: (None, "c"), 6: ("", "")}
    pick = lambda k: F.create_map(*[x for i, t in texts.items() for x in (F.lit(i), F.lit(t[k]).cast("string"))])[F.col("message_id").cast("int")]
    posts = v.stored_posts.limit(1).drop("message_id").crossJoin(spark.range(1, 7).withColumnRenamed("id", "message_id"))
    posts = posts.withColumns({"original_text": pick(0), "normalized_text": pick(1)}).select(*v.stored_posts.columns)
    store = PostStore(str(tmp_path / "store"), posts.schema, buckets=4).create(posts)
    assert {r.message_id: (r.original_text, r.normalized_text) for r in store.read(spark).collect()} == texts
    assert store.read(spark).schema.names == posts.schema.names
    written = spark.read.parquet(str(tmp_path / "store" / "rows"))
    assert {r.message_id for r in written.filter("normalized_text is not null").collect()} == {2, 5}


def test_a_first_merge_can_be_repeated(spark, tmp_path):
    v = Views(spark, FOLDER)
    store = PostStore(str(tmp_path / "store"), v.stored_posts.schema, buckets=4)
    log = v.envelopes.filter("seq < 300")
    for _ in range(2):
        store.merge(log, 1, changed_only=True)
    assert store.read(spark).count() == log.select("source_id", "message_id").distinct().count()
    store.merge(log.filter("seq < 0"), 2, changed_only=True)  # an empty micro-batch
    store.merge(v.envelopes.filter("seq = 299"), 3, changed_only=True)
    assert set(store.heads(spark).values()) == {1}  # nothing has changed


def test_pages_stream_into_the_store(spark, tmp_path):
    v = Views(spark, FOLDER)
    store = PostStore(str(tmp_path / "store"), v.stored_posts.schema, buckets=8)
    landing = str(tmp_path / "pages")
    first = '<div class="tgme_page_widget"><div data-post="chan/11"><div class="tgme_widget_message_text">{}</div></div></div>'
    for html, minute in ((first.format("a"), 0), (first.format("a"), 1), ("<p>foreign</p>", 2), (first.format("b"), 3)):
        rows = page(spark, html).withColumn("fetched_at", F.lit(T0 + dt.timedelta(minutes=minute)))
        rows.coalesce(1).write.mode("append").parquet(landing)
        J.store_stream(J.page_stream(spark, landing), v.sources, store, str(tmp_path), once=True).awaitTermination()
    (row,) = store.read(spark).collect()
    cursor = v.sources.filter(F.col("source_id") == row.source_id).first()
    edits = cursor is not None and (cursor.last_seen_message_id or 0) >= 11
    assert row.original_text == ("b" if edits else "a") and row.observed_at == T0 + dt.timedelta(minutes=3)
    assert [r.warning for r in spark.read.parquet(str(tmp_path / "quarantine")).collect()] == ["not_a_telegram_public_page"]
    versions = {h for h in store.heads(spark).values()}
    assert versions == {4}  # the second and third batch changed nothing


def test_rows_behind_the_watermark_are_counted_apart(spark, tmp_path):
    batches = [[0, 1, 6, 40], [2, 39, 12, 41], [0]]
    for minutes in batches:
        rows = spark.createDataFrame([(T0 + dt.timedelta(minutes=m),) for m in minutes], "ts timestamp")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        log = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        J.rate_stream(log, str(tmp_path / "out"), 10, once=True).awaitTermination()
    got = {r.window_start: (r.publications, r.late) for r in J.read_rates(spark, str(tmp_path / "out")).collect()}
    assert got == {T0 + dt.timedelta(minutes=m): n for m, n in {0: (4, 2), 5: (1, 0), 10: (1, 1), 35: (1, 0), 40: (2, 0)}.items()}


def test_landed_tables_are_made_by_many_tasks(spark, tmp_path):
    """A table that lands for one micro-batch is one file, but no single task makes all its rows."""
    from types import SimpleNamespace

    from corroborate.catalog.stream_queries import _landed

    makers = spark.sparkContext.accumulator(0)

    def made(batches):
        makers.add(1)
        yield from batches

    _landed(SimpleNamespace(spark=spark), str(tmp_path / "in"), [spark.range(0, 40, 1, 4).mapInArrow(made, "id bigint")])
    assert makers.value == 4 and len(list((tmp_path / "in").glob("*.parquet"))) == 1


STAMP = """
import sys
from corroborate.catalog.views import Views
from corroborate.session import local_session, plan_stamp

folder, shared, before = sys.argv[1:]
spark = local_session("1", shared=shared)
[spark._jvm.java.lang.Object().hashCode() for _ in range(int(before))]  # moves the random hashes of this session on
print(plan_stamp(Views(spark, folder)._derive_posts()))
"""


def test_another_session_finds_the_derived_table(tmp_path):
    """The place of a derived table follows from its rules, not from the session that writes it."""
    root = str(Path(__file__).resolve().parents[1])
    runs = [subprocess.run([sys.executable, "-c", STAMP, FOLDER, str(tmp_path), n], cwd=root, capture_output=True, text=True, check=True) for n in "036"]
    assert len({run.stdout for run in runs}) == 1
