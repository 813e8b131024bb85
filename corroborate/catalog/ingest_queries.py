"""Registered queries over pages, stored posts, the registry and manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corroborate.catalog import duck as d
from corroborate.catalog.registry import query
from corroborate.catalog.views import now
from corroborate.functions import html
from corroborate.functions.timefn import is_stale
from corroborate.operators import batches as B
from corroborate.operators import posts as P
from corroborate.operators.blocks import join_few
from corroborate.session import shared_folder
from corroborate.sources import envelopes as E
from corroborate.sources import manifest as M
from corroborate.sources import pages as G
from corroborate.sources import registry as R
from corroborate.sources import sinks as S
from corroborate.sources.store import PostStore

AT = "coalesce(published_at, observed_at)"


@query("page_scan", "A1", d.sql("SELECT page_id, url, strlen(html) AS bytes, sha256(html) AS html_hash FROM pages"))
def _(v):
    capped = G.cap_pages(v.table("pages"))
    return capped.select("page_id", "url", F.octet_length("html").cast("bigint").alias("bytes"), F.sha2("html", 256).alias("html_hash"))


@query(
    "page_warnings", "A3",
    d.sql("""SELECT page_id, CASE WHEN contains(html, 'tgme_page_widget') THEN 'page_has_no_message_markers' ELSE 'not_a_telegram_public_page' END AS warning
             FROM pages WHERE NOT regexp_matches(html, 'data-post="[^"]+/[0-9]+"')"""),
)
def _(v):
    return G.page_warnings(v.table("pages")).select("page_id", "warning")


_MEDIA = "CASE doc_id % 4 WHEN 1 THEN 'photo' WHEN 2 THEN 'video' END"
_URL = "'https://t.me/chan/' || post_id"


@query(
    "parse_pages", "A2 H11 H12 H13 H14 H10",
    d.sql(f"""SELECT message_id, source_id, canonical_url, published_at, media_type, edited, forwarded_from, cited_source, chars, content_hash FROM (
        SELECT message_id, doc_id % 20 + 1 AS source_id, {_URL} AS canonical_url, {d.iso('published_at')} AS published_at, {_MEDIA} AS media_type,
               doc_id % 6 = 0 AS edited, CASE WHEN doc_id % 17 = 0 THEN 'irna_1313' END AS forwarded_from, {d.cited('t')} AS cited_source,
               length(t) AS chars, sha256({_URL} || chr(10) || t || chr(10) || coalesce({_MEDIA}, '')) AS content_hash
        FROM (SELECT *, {d.trim("replace(replace(original_text, '>', '>'), chr(13), chr(13))")} AS t FROM raw_posts))"""),
)
def _(v):
    """Marker pages must parse back into the posts they were made from."""
    return G.parse_pages(v.channel_pages).select(
        "message_id",
        "source_id",
        "canonical_url",
        "published_at",
        "media_type",
        F.col("edited_at").isNotNull().alias("edited"),
        F.get_json_object("metadata", "$.forwarded_from").alias("forwarded_from"),
        F.get_json_object("metadata", "$.cited_source").alias("cited_source"),
        F.char_length("text").alias("chars"),
        "content_hash",
    )


@query(
    "changed_posts", "B2 B3",
    d.sql("""SELECT p.post_id, p.source_id, CASE WHEN s.last_seen_message_id IS NOT NULL AND p.message_id <= s.last_seen_message_id THEN 'edit' ELSE 'create' END AS update_type
             FROM raw_posts p JOIN sources s USING (source_id) LEFT JOIN labels l ON l.doc_id = p.doc_id AND l.quality = 1 WHERE l.doc_id IS NULL"""),
)
def _(v):
    """Posts whose stored fingerprint is missing, or outdated (quality 0)."""
    parsed = v.raw_posts.withColumn("content_hash", F.sha2("canonical_url", 256))
    label = v.table("labels").withColumn("post_id", F.col("doc_id") + 1)
    stored = parsed.join(label.select("post_id", "quality"), "post_id").withColumn(
        "content_hash", F.when(F.col("quality") == 1, F.col("content_hash")).otherwise(F.lit("old"))
    )
    changed = G.changed_posts(parsed, stored)
    return G.to_envelopes(changed.drop("language"), v.sources).select("post_id", "source_id", "update_type")


_SEEDED = f"""
    SELECT source AS source_key, count(*) AS n FROM documents GROUP BY 1"""


@query(
    "upsert_sources", "A4 A5",
    d.sql("""SELECT source_id, source_key, 'Seed ' || source_key AS name, CASE WHEN source_id % 3 = 0 THEN 'TIER_1' ELSE 'TIER_2' END AS priority_tier, is_active, health_status,
             coalesce(last_seen_message_id, -1) AS last_seen FROM sources
             UNION ALL SELECT (SELECT max(source_id) FROM sources) + row_number() OVER (ORDER BY 'new_' || source_key), 'new_' || source_key, 'Seed new_' || source_key, 'TIER_2', false, 'pending_validation', -1 FROM sources"""),
)
def _(v):
    """Every channel is seeded again under new names, plus one new key each."""
    listed = v.sources.select("source_key", "source_id").unionByName(
        v.sources.select(F.concat(F.lit("new_"), "source_key").alias("source_key"), F.lit(None).cast("bigint").alias("source_id"))
    )
    tier = F.when(F.col("source_id") % 3 == 0, F.lit("TIER_1")).otherwise(F.lit("TIER_2"))
    text = F.to_json(
        F.struct(
            "source_key",
            F.concat(F.lit("Seed "), "source_key").alias("name"),
            F.concat(F.lit("u_"), "source_key").alias("telegram_username"),
            F.lit("specialist").alias("role"),
            tier.alias("priority_tier"),
            F.lit("WORLD").alias("category"),
            F.lit("fa").alias("language"),
            F.lit("press").alias("source_type"),
            F.lit(0.6).alias("trust_score"),
            F.lit(False).alias("is_wire_origin"),
        )
    )
    seeds = R.seeds_from_json(listed.select(text.alias("seed")), "seed")
    return R.upsert_sources(v.sources, seeds).select(
        "source_id",
        "source_key", "name", "priority_tier", "is_active", "health_status", F.coalesce("last_seen_message_id", F.lit(-1)).alias("last_seen")
    )


@query(
    "due_sources", "B1",
    d.sql(f"""SELECT source_id, source_key FROM sources WHERE is_active AND (next_poll_at IS NULL OR next_poll_at <= {d.NOW})
              ORDER BY coalesce(next_poll_at, TIMESTAMP '1970-01-01'), source_id LIMIT 5"""),
)
def _(v):
    return R.due_sources(v.sources, now()).select("source_id", "source_key")


@query(
    "poll_gaps", "B4",
    d.sql("""SELECT poll_id, coalesce(cursor, -1) AS cursor, coalesce(earliest_id > cursor + 1, false) AS gap_suspected FROM (
             SELECT *, last_value(latest_id IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY polled_at, poll_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cursor FROM polls)"""),
)
def _(v):
    return R.poll_gaps(v.polls).select("poll_id", F.coalesce("cursor", F.lit(-1)).alias("cursor"), "gap_suspected")


@query(
    "poll_health", "B5",
    d.sql(f"""SELECT source_id, CASE WHEN p.ok THEN 'healthy' WHEN NOT p.ok THEN 'degraded' ELSE s.health_status END AS health_status,
        {d.iso("CASE WHEN p.polled_at IS NULL THEN s.next_poll_at WHEN p.ok THEN p.polled_at + INTERVAL 300 SECOND ELSE p.polled_at + INTERVAL 600 SECOND END")} AS next_poll_at,
        {d.iso('coalesce(p.success, s.last_polled_at)')} AS last_polled_at, coalesce(p.cursor, s.last_seen_message_id, -1) AS last_seen,
        CASE WHEN p.polled_at IS NULL THEN s.last_error WHEN NOT p.ok THEN left(p.error, 500) END AS last_error
        FROM sources s LEFT JOIN (SELECT source_id, arg_max(ok, (polled_at, poll_id)) AS ok, max(polled_at) AS polled_at,
             max(polled_at) FILTER (ok) AS success, arg_max(error, (polled_at, poll_id)) FILTER (error IS NOT NULL) AS error,
             arg_max(latest_id, (polled_at, poll_id)) FILTER (ok AND latest_id IS NOT NULL) AS cursor FROM polls GROUP BY source_id) p USING (source_id)"""),
)
def _(v):
    return R.apply_poll_log(v.sources, v.polls).select(
        "source_id", "health_status", "next_poll_at", "last_polled_at", F.coalesce("last_seen_message_id", F.lit(-1)).alias("last_seen"), "last_error"
    )


@query(
    "validate_envelopes", "A6",
    d.sql("""SELECT event_id, concat_ws(',', CASE WHEN event_id % 50 = 0 THEN 'schema_version' END, CASE WHEN user_id % 9 = 0 THEN 'source_id' END,
             CASE WHEN event_type = 'error' THEN 'update_type' END, CASE WHEN cents % 7 = 0 THEN 'observed_at' END,
             CASE WHEN cents % 5 = 0 THEN 'post.content_hash' END, CASE WHEN cents % 3 = 0 THEN 'post.metadata' END) AS reasons FROM log"""),
)
def _(v):
    cents, event = F.col("cents"), F.col("event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    kind = F.when(F.col("event_type") == "error", F.lit("remove")).when(F.col("event_type") == "click", F.lit("edit")).otherwise(F.lit("create"))
    post = F.struct(
        F.lit(1).alias("source_id"),
        F.lit("key").alias("source_key"),
        F.lit("user").alias("username"),
        (event + 1).alias("message_id"),
        F.lit("https://t.me/c/1").alias("canonical_url"),
        stamp.alias("published_at"),
        F.lit(None).cast("string").alias("edited_at"),
        F.col("props").alias("text"),
        F.lit(None).cast("string").alias("media_type"),
        F.when(cents % 5 == 0, F.lit("XYZ")).otherwise(F.sha2("props", 256)).alias("content_hash"),
        F.lit("").alias("raw_html_snippet"),
        F.when(cents % 3 == 0, F.lit("[1]")).otherwise(F.col("props")).alias("metadata"),
    )
    rows = v.log.select(
        "event_id",
        F.when(event % 50 == 0, F.lit(2)).otherwise(F.lit(1)).alias("schema_version"),
        F.lit("telegram_public_web").alias("transport"),
        (F.col("user_id") % 9).alias("source_id"),
        F.lit("key").alias("source_key"),
        (event + 1).alias("external_message_id"),
        kind.alias("update_type"),
        F.when(cents % 7 == 0, F.lit("yesterday")).otherwise(stamp).alias("observed_at"),
        post.alias("post"),
    )
    return E.check_envelopes(rows).select("event_id", "reasons")


_MERGED = d.sql(f"""SELECT source_id, message_id, {d.iso('published_at')} AS published_at, {d.iso('edited_at')} AS edited_at, {d.iso('observed_at')} AS observed_at,
        original_text, content_hash, media_type, is_deleted, processing_status, attempts FROM (
        SELECT source_id, message_id, coalesce(o.published_at, e.published_at) AS published_at,
          CASE WHEN e.edit_seq IS NOT NULL AND (o.content_hash IS NOT NULL OR e.edit_seq > e.first_seq) THEN e.edit_observed
               WHEN o.content_hash IS NULL THEN e.first_edited END AS edited_at,
          coalesce(e.observed_at, o.observed_at) AS observed_at,
          CASE WHEN e.edit_seq IS NOT NULL THEN e.edit_text WHEN o.content_hash IS NOT NULL THEN ' old text' ELSE e.first_text END AS original_text,
          coalesce(e.content_hash, o.content_hash) AS content_hash, coalesce(e.media_type, o.media_type) AS media_type,
          coalesce(o.is_deleted, false) OR coalesce(e.any_delete, false) AS is_deleted,
          CASE WHEN o.content_hash IS NULL THEN 'pending' WHEN e.first_seq IS NULL THEN 'analyzed'
               WHEN NOT o.is_deleted AND NOT e.any_delete AND e.hashes = [o.content_hash] THEN 'analyzed' ELSE 'pending' END AS processing_status,
          CASE WHEN o.content_hash IS NULL THEN 0 WHEN e.first_seq IS NULL THEN 2
               WHEN NOT o.is_deleted AND NOT e.any_delete AND e.hashes = [o.content_hash] THEN 2 ELSE 0 END AS attempts
        FROM stored_posts o FULL JOIN (SELECT source_id, message_id, min(seq) AS first_seq,
            arg_min(published_at, seq) FILTER (published_at IS NOT NULL) AS published_at, max(seq) FILTER (update_type = 'edit') AS edit_seq,
            arg_max(observed_at, seq) FILTER (update_type = 'edit') AS edit_observed, list(edited_at ORDER BY seq)[1] AS first_edited,
            max(observed_at) AS observed_at, arg_max(text, seq) FILTER (update_type = 'edit') AS edit_text, arg_min(text, seq) AS first_text,
            arg_max(content_hash, seq) AS content_hash, arg_max(media_type, seq) FILTER (media_type IS NOT NULL) AS media_type,
            bool_or(update_type = 'delete') AS any_delete, list(DISTINCT content_hash) AS hashes
          FROM envelopes GROUP BY source_id, message_id) e USING (source_id, message_id))""")
_MERGED_COLUMNS = (
    "source_id", "message_id", "published_at", "edited_at", "observed_at", "original_text", "content_hash", "media_type",
    "is_deleted", "processing_status", "analysis_attempts as attempts",
)


@query("upsert_raw_posts", "A7", _MERGED)
def _(v):
    return P.upsert_raw_posts(v.stored_posts, v.envelopes).selectExpr(*_MERGED_COLUMNS)


@query("merged_store", "A7", _MERGED)
def _(v):
    """The log in four parts, each merged into the buckets it touches, must give what one merge of all gives."""
    path = f"{shared_folder(v.spark)}/stores/{uuid.uuid4().hex}"
    store = PostStore(path, v.stored_posts.schema, buckets=32).create(v.stored_posts)
    parts = 4
    most = v.envelopes.agg(F.max("seq")).first()[0] or 0
    for part in range(parts):
        share = F.floor(F.col("seq") * parts / (most + 1)) == part
        store.merge(v.envelopes.filter(share), part + 1)
    return store.read(v.spark).selectExpr(*_MERGED_COLUMNS)


_STATUS = "CASE WHEN processing_status IN ('queued', 'analyzing', 'analyzed', 'noise') THEN processing_status ELSE 'pending' END"
_NEXT = f"""CASE WHEN is_deleted OR noise_reason IS NOT NULL THEN 'noise'
    WHEN processing_status IN ('noise', 'analyzed') AND analysis_content_hash = sha256(normalized_text) THEN processing_status ELSE {_STATUS} END"""


@query(
    "normalize_posts", "B9",
    d.sql(f"""SELECT post_id, next AS processing_status, is_deleted OR noise_reason IS NOT NULL AS is_noise, noise_reason,
              CASE WHEN next IN ('noise', 'analyzed') THEN sha256(normalized_text) ELSE analysis_content_hash END AS analysis_hash,
              next NOT IN ('noise', 'analyzed') AND analysis_lease_at IS NOT NULL AS leased FROM (SELECT *, {_NEXT} AS next FROM posts)"""),
)
def _(v):
    return P.normalize_posts(v.posts).select(
        "post_id", "processing_status", "is_noise", "noise_reason",
        F.col("analysis_content_hash").alias("analysis_hash"), F.col("analysis_lease_at").isNotNull().alias("leased"),
    )


@query(
    "mark_noise", "B10",
    d.sql("""SELECT post_id, CASE WHEN n THEN 'noise' ELSE processing_status END AS processing_status, n OR is_noise AS is_noise,
             CASE WHEN n THEN 'llm_noise' ELSE noise_reason END AS noise_reason, NOT n AND analysis_lease_at IS NOT NULL AS leased
             FROM (SELECT p.*, p.post_id IN (SELECT post_id FROM decision_posts WHERE action = 'NOISE') AS n FROM posts p)"""),
)
def _(v):
    return P.mark_noise(v.posts, v.decisions).select(
        "post_id", "processing_status", "is_noise", "noise_reason", F.col("analysis_lease_at").isNotNull().alias("leased")
    )


@query(
    "requeue_legacy", "A14",
    d.sql("""SELECT CASE WHEN processing_status IN ('processing', 'embedding', 'embedded') THEN 'pending' ELSE processing_status END AS processing_status,
             count(*) AS posts, count(CASE WHEN processing_status NOT IN ('processing', 'embedding', 'embedded') THEN analysis_lease_at END) AS leases FROM posts GROUP BY 1"""),
)
def _(v):
    return P.requeue_legacy(v.posts).groupBy("processing_status").agg(F.count("*").alias("posts"), F.count("analysis_lease_at").alias("leases"))


_ELIGIBLE = "NOT is_deleted AND NOT is_noise AND processing_status = 'pending'"


@query("eligible_posts", "B6", d.sql(f"SELECT post_id FROM posts WHERE {_ELIGIBLE}"))
def _(v):
    return P.eligible(v.posts).select("post_id")


@query(
    "batch_due", "B7",
    d.sql(f"""SELECT pending, overdue, pending > 0 AND (minute({d.NOW}) % 5 = 0 AND second({d.NOW}) < 30 OR overdue > 0) AS due FROM (
              SELECT count(*) AS pending, count(*) FILTER (created_at <= {d.NOW} - INTERVAL 5 MINUTE) AS overdue FROM posts WHERE {_ELIGIBLE})"""),
)
def _(v):
    return P.batch_due(v.posts, now())


@query("stale_leases", "B8", d.sql(f"SELECT post_id, analysis_lease_at IS NULL OR analysis_lease_at <= {d.NOW} - INTERVAL 10 MINUTE AS stale FROM posts"))
def _(v):
    return v.posts.select("post_id", is_stale(F.col("analysis_lease_at"), now()).alias("stale"))


_BATCH_STATE = d.cycle(("queued", "processing", "completed", "failed"), "batch_id % 4")


def _batches(v):
    state = F.element_at(F.array(*[F.lit(s) for s in ("queued", "processing", "completed", "failed")]), (F.col("batch_id") % 4 + 1).cast("int"))
    return v.batch_posts.groupBy("batch_id").agg(F.min("post_id").alias("first_post")).withColumn("status", state)


@query(
    "orphan_posts", "C6 J6",
    d.sql(f"""SELECT post_id FROM posts p WHERE NOT is_deleted AND processing_status = 'analyzing' AND (analysis_lease_at IS NULL OR analysis_lease_at <= {d.NOW} - INTERVAL 10 MINUTE)
              AND NOT EXISTS (SELECT 1 FROM batch_posts b WHERE b.post_id = p.post_id AND {_BATCH_STATE} IN ('queued', 'processing'))"""),
)
def _(v):
    return P.orphan_posts(v.posts, v.batch_posts, _batches(v), now()).select("post_id")


@query(
    "release_posts", "C7",
    d.sql(f"""SELECT post_id, CASE WHEN back THEN 'pending' ELSE processing_status END AS processing_status, NOT back AND analysis_lease_at IS NOT NULL AS leased FROM (
              SELECT p.*, processing_status = 'analyzing' AND {_BATCH_STATE} = 'failed' AS back FROM posts p JOIN batch_posts b USING (post_id))"""),
)
def _(v):
    failed = v.batch_posts.join(_batches(v).filter("status = 'failed'"), "batch_id").select("post_id")
    return P.release_posts(v.posts, failed).select("post_id", "processing_status", F.col("analysis_lease_at").isNotNull().alias("leased"))


@query(
    "load_reports", "A10 C1",
    d.sql("SELECT p.post_id, s.name AS source_name, s.source_key FROM raw_posts p JOIN sources s USING (source_id) WHERE p.doc_id IN (SELECT doc_id FROM labels)"),
)
def _(v):
    ids = v.table("labels").select((F.col("doc_id") + 1).alias("post_id"))
    return P.load_reports(v.raw_posts, v.sources, ids).select("post_id", "source_name", "source_key")


@query(
    "search_posts", "B20",
    d.sql("SELECT post_id FROM posts p JOIN sources s USING (source_id) WHERE processing_status = 'pending' AND contains(lower(s.name || ' ' || original_text || ' ' || normalized_text), 'tehran')"),
)
def _(v):
    named = join_few(v.posts, v.sources.select("source_id", F.col("name").alias("source_name")), "source_id")
    return P.search_posts(named, "pending", " TEHRAN ").select("post_id")


@query("search_events", "B20", d.sql("SELECT event_id FROM event_rows WHERE verification_status = 'DISPUTED'"))
def _(v):
    return P.search_events(v.events, "DISPUTED").select("event_id")


@query(
    "append_new", "A8",
    d.sql(f"""SELECT source_id, message_id, 'stored' AS origin, {d.iso('observed_at')} AS observed_at FROM stored_posts
              UNION ALL SELECT source_id, message_id, 'log', {d.iso('min(observed_at)')} FROM envelopes e
              WHERE NOT EXISTS (SELECT 1 FROM stored_posts o WHERE o.source_id = e.source_id AND o.message_id = e.message_id) GROUP BY 1, 2"""),
)
def _(v):
    target = v.stored_posts.select("source_id", "message_id", F.lit("stored").alias("origin"), "observed_at")
    rows = v.envelopes.select("source_id", "message_id", F.lit("log").alias("origin"), "observed_at", "seq")
    return S.append_new(target, rows, ["source_id", "message_id"], ["seq"])


@query(
    "upsert_latest", "A9",
    d.sql(f"""SELECT source_id, message_id, max(origin) AS origin, {d.iso('max(observed_at)')} AS observed_at FROM (
              SELECT source_id, message_id, 'log' AS origin, observed_at FROM stored_posts UNION ALL SELECT source_id, message_id, 'new', observed_at FROM envelopes) GROUP BY 1, 2"""),
)
def _(v):
    target = v.stored_posts.select("source_id", "message_id", F.lit("log").alias("origin"), "observed_at")
    rows = v.envelopes.select("source_id", "message_id", F.lit("new").alias("origin"), "observed_at")
    return S.upsert_latest(target, rows, ["source_id", "message_id"], ["observed_at"])


# --- samples and manifests ---------------------------------------------------
@query("latest_sample", "F10 B21", d.sql(f"SELECT post_id FROM posts WHERE NOT is_deleted AND NOT is_noise AND normalized_text <> '' ORDER BY {AT} DESC, post_id DESC LIMIT 500"))
def _(v):
    return M.latest_sample(v.posts, 500).select("post_id")


@query("sample_by_ids", "B21", d.sql("SELECT post_id FROM posts WHERE NOT is_deleted AND NOT is_noise AND doc_id IN (SELECT doc_id FROM labels)"))
def _(v):
    return M.sample_by_ids(v.posts, v.table("labels").select((F.col("doc_id") + 1).alias("post_id"))).select("post_id")


_SAMPLE = f"SELECT post_id, {AT} AS seen FROM posts WHERE NOT is_deleted AND NOT is_noise ORDER BY {AT} DESC, post_id DESC LIMIT 500"


@query(
    "build_manifest", "A12",
    d.sql(f"SELECT {d.iso('time_bucket(INTERVAL 5 MINUTE, seen)')} AS window_end, string_agg(post_id::VARCHAR, ',' ORDER BY seen DESC, post_id DESC) AS post_ids FROM sampled GROUP BY 1", {"sampled": _SAMPLE}),
)
def _(v):
    return M.build_manifest(v.posts)


@query(
    "check_manifest", "A11",
    d.sql("""SELECT count(*) AS entries, count(DISTINCT post_id) AS unique_posts, count(DISTINCT time_bucket(INTERVAL 5 MINUTE, seen)) AS windows,
             count(*) FILTER (post_id - 1 NOT IN (SELECT doc_id FROM labels)) AS missing, false AS valid FROM sampled""", {"sampled": _SAMPLE}),
)
def _(v):
    """The built manifest checked against a store that lost the unlabelled posts."""
    entries = M.build_manifest(v.posts).select("window_end", F.explode("post_ids").alias("post_id"))
    return M.check_manifest(entries, v.table("labels").select((F.col("doc_id") + 1).alias("post_id")))


# --- batches -----------------------------------------------------------------
_FRESH = f"created_at >= {d.NOW} - INTERVAL 15 MINUTE"


@query("claim_order", "F1 J5", d.sql(f"SELECT post_id, {_FRESH} AS is_fresh FROM posts WHERE {_ELIGIBLE} ORDER BY {_FRESH} DESC, created_at, post_id LIMIT 128"))
def _(v):
    return B.claim_order(v.posts, now()).select("post_id", "is_fresh")


_JSON = f"""length(json_object('post_id', post_id, 'source_id', source_id, 'source_name', name, 'published_at', {d.iso('published_at')},
    'observed_at', {d.iso('observed_at')}, 'text', left(normalized_text, 1800))::VARCHAR)"""
_SIZED = f"SELECT p.*, s.name, {_JSON} AS size FROM posts p JOIN sources s USING (source_id)"


@query(
    "pack_batch", "E1",
    d.sql(f"""SELECT post_id, position, size + 32 AS size FROM (SELECT *, row_number() OVER w AS position, sum(size + 32) OVER w AS total FROM (
              SELECT *, {_FRESH} AS fresh FROM sized WHERE {_ELIGIBLE} ORDER BY {_FRESH} DESC, created_at, post_id LIMIT 128)
              WINDOW w AS (ORDER BY fresh DESC, created_at, post_id)) WHERE position <= 32 AND (position = 1 OR total <= 30000)""", {"sized": _SIZED}),
)
def _(v):
    claimed = B.claim_order(v.posts, now()).join(v.sources.select("source_id", F.col("name").alias("source_name")), "source_id")
    return B.pack_batch(claimed, 30_000).select("post_id", "position", "size")


_PACKED = {
    "sized": _SIZED,
    "placed": f"SELECT post_id, time_bucket(INTERVAL 5 MINUTE, {AT}) AS w, size, row_number() OVER (PARTITION BY time_bucket(INTERVAL 5 MINUTE, {AT}) ORDER BY {AT} DESC, post_id DESC) AS n FROM sized WHERE NOT is_deleted AND noise_reason IS NULL",
    "packed": """SELECT w, n, post_id, 0 AS seq, size AS chars, 1 AS held FROM placed WHERE n = 1
        UNION ALL SELECT p.w, p.n, p.post_id, CASE WHEN k.held >= 32 OR 2 + k.chars + p.size + k.held > 50000 THEN k.seq + 1 ELSE k.seq END,
          CASE WHEN k.held >= 32 OR 2 + k.chars + p.size + k.held > 50000 THEN p.size ELSE k.chars + p.size END,
          CASE WHEN k.held >= 32 OR 2 + k.chars + p.size + k.held > 50000 THEN 1 ELSE k.held + 1 END
        FROM packed k JOIN placed p ON p.w = k.w AND p.n = k.n + 1""",
}


@query("pack_windows", "E2 J2", "WITH RECURSIVE " + ", ".join([f"{n} AS ({d.VIEWS[n]})" for n in ("raw_posts", "posts", "sources")] + [f"{n} AS ({s})" for n, s in _PACKED.items()]) + f" SELECT {d.iso('w')} || ':' || seq AS batch_key, post_id FROM packed")
def _(v):
    reports = B.window_reports(v.posts, v.sources)
    packed = B.pack_windows(reports)
    return packed.select(B.batch_key(F.col("window_end"), F.col("batch_sequence")).alias("batch_key"), "post_id")


@query(
    "next_sequences", "D8",
    d.sql(f"""SELECT c.event_id AS batch_id, {d.iso('c.w')} AS window_end, coalesce(b.base, 0) + row_number() OVER (PARTITION BY c.w ORDER BY c.event_id) - 1 AS batch_sequence
              FROM (SELECT event_id, time_bucket(INTERVAL 5 MINUTE, first_seen_at) AS w FROM event_rows) c
              LEFT JOIN (SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS w, max(event_id % 4) + 1 AS base FROM stories GROUP BY 1) b ON b.w = c.w"""),
)
def _(v):
    from corroborate.functions.timefn import window_end

    new = v.events.select(F.col("event_id").alias("batch_id"), window_end(F.col("first_seen_at")).alias("window_end"))
    existing = v.stories.select(window_end(F.col("created_at")).alias("window_end"), (F.col("event_id") % 4).alias("batch_sequence"))
    return B.next_sequences(existing, new)


@query(
    "density_groups", "E9",
    d.sql("""SELECT g AS group_no, position, post_id FROM (SELECT post_id, row_number() OVER (ORDER BY published_at, post_id) AS position, count(*) OVER () AS total FROM raw_posts) p
             JOIN (SELECT unnest(range(10)) AS g) ON position > (g * (total - 28)) // 9 AND position <= (g * (total - 28)) // 9 + 28"""),
)
def _(v):
    return B.density_groups(v.raw_posts)
