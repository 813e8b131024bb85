"""Registered queries that run a stream over the given tables to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corroborate.catalog import duck as d
from corroborate.catalog.event_queries import _RESOLVED
from corroborate.catalog.ingest_queries import _MEDIA, _URL, _batches
from corroborate.catalog.ops_queries import _CAP, caps
from corroborate.catalog.registry import QUERIES, query
from corroborate.catalog.views import BASE, now
from corroborate.functions import sql as S
from corroborate.functions.text import let, set_overlap, tokens
from corroborate.operators import clusters as C
from corroborate.session import pieces, released_shuffles, remove, shared_folder, stored_meanwhile
from corroborate.streaming import jobs as J


def _run_folder(v) -> str:
    return f"{shared_folder(v.spark)}/streams/{uuid.uuid4().hex}"


def _events_stream(v):
    batch = v.table("events")
    stream = v.spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(v.folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("cents", F.floor(F.col("value") * 100 + 0.5))


_CHANGED = """SELECT seq, source_id, message_id FROM (SELECT *, lag(content_hash) OVER (PARTITION BY source_id, message_id ORDER BY seq) AS before FROM envelopes) WHERE content_hash IS DISTINCT FROM before"""


@query("changed_log", "J4 B2", d.sql(_CHANGED))
def _(v):
    rows = v.envelopes.select("seq", "source_id", "message_id", "content_hash")
    return J.changed_log(rows).select("seq", "source_id", "message_id")


@query("stream_fingerprints", "J4", d.sql(_CHANGED))
def _(v):
    """The fingerprint state over a stream must agree with the batch form."""
    out = _run_folder(v)
    e = F.col("event_id")
    rows = _events_stream(v).select(
        e.alias("seq"),
        (F.col("user_id") % 20 + 1).alias("source_id"),
        (e % 2003 + 1).alias("message_id"),
        F.sha2((F.col("cents") % 3).cast("string"), 256).alias("content_hash"),
    )
    J._write(J.changed_stream(rows), f"{out}/rows", f"{out}/check", once=True).awaitTermination()
    return v.spark.read.parquet(f"{out}/rows").select("seq", "source_id", "message_id")


@query("stream_counters", "J8 D3", d.sql("SELECT strftime(ts, '%Y-%m-%d') AS counter_date, event_type AS metric, CAST(sum(cents) AS BIGINT) AS value FROM log GROUP BY 1, 2"))
def _(v):
    out = _run_folder(v)
    rows = _events_stream(v).select("ts", F.col("event_type").alias("metric"), F.col("cents").alias("amount"))
    J.counter_stream(rows, out, once=True).awaitTermination()
    return J.read_counters(v.spark, out)


@query(
    "stream_admissions", "J8 E3",
    d.sql(f"SELECT call_id, {_CAP} > 0 AND position <= {_CAP} AS admitted FROM (SELECT *, row_number() OVER (PARTITION BY day, stage ORDER BY ts, call_id) AS position FROM calls)"),
)
def _(v):
    out = _run_folder(v)
    rows = _events_stream(v).select(
        F.col("event_id").alias("call_id"), "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("stage")
    )
    J.admission_stream(rows, caps(), out, once=True).awaitTermination()
    return v.spark.read.parquet(f"{out}/calls").select("call_id", "admitted")


_AGAIN = f"({d.NOW} + INTERVAL 5 MINUTE)"
_POLLED = {
    "polled": f"""SELECT r.message_id, doc_id % 20 + 1 AS source_id, doc_id % 6 = 0 AS marked, (doc_id % 20 + 1) % 3 = 0 AS again, coalesce(r.message_id <= s.last_seen_message_id, false) AS edit, {d.trim('original_text')} AS t, {d.trim("original_text || ' (corrected)'")} AS u,
        {_URL} || chr(10) AS head, chr(10) || coalesce({_MEDIA}, '') AS tail FROM raw_posts r LEFT JOIN sources s ON s.source_id = doc_id % 20 + 1""",
}


@query(
    "ingest_pages", "J1 A7 B2 B3",
    d.sql(f"""SELECT source_id, message_id, CASE WHEN again AND edit THEN u ELSE t END AS original_text, sha256(head || CASE WHEN again THEN u ELSE t END || tail) AS content_hash,
              CASE WHEN edit THEN 'edit' ELSE 'create' END AS update_type, {d.iso(f"CASE WHEN again THEN {_AGAIN} ELSE {d.NOW} END")} AS observed_at,
              CASE WHEN again AND edit THEN {d.iso(_AGAIN)} WHEN marked THEN {d.iso(d.NOW)} END AS edited_at, 'pending' AS processing_status FROM polled""", _POLLED),
)
def _(v):
    """Pages polled twice by a stream that is stopped in between: a third of the channels has corrected its posts."""
    out = _run_folder(v)
    store = J.PostStore(f"{out}/store", v.stored_posts.schema)

    files = -(-pieces(v.table("documents")) // 2)  # of one micro-batch; a landing is two

    def land(pages):
        with stored_meanwhile(pages) as made, released_shuffles(v.spark):  # pages are made and dealt out one after the other
            made.repartition(2 * files, "url").write.mode("append").option("compression", "zstd").parquet(f"{out}/pages")
        J.store_stream(J.page_stream(v.spark, f"{out}/pages", files), v.sources, store, out, once=True).awaitTermination()
        remove(v.spark, f"{out}/pages")  # all of them are in the store
        store.forget(v.spark)

    land(v.channel_pages)
    corrected = F.when(F.col("source_id") % 3 == 0, F.replace("html", F.lit("</div><time"), F.lit(" (corrected)</div><time"))).otherwise(F.col("html"))
    land(v.channel_pages.withColumns({"html": corrected, "fetched_at": F.col("fetched_at") + F.expr("interval 5 minutes")}))
    columns = ["source_id", "message_id", "original_text", "content_hash", "update_type", "observed_at", "edited_at", "processing_status"]
    return store.read(v.spark).select(*columns)


def _landed(v, out, parts):
    """A stream over tables that landed one after the other, a micro-batch for each.

    A table is one file, but is made by as many tasks as it needs; only its few columns go to the task that writes it.
    """
    for part in parts:
        part.repartition(1).write.mode("append").parquet(out)
    return v.spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(out)


@query(
    "stream_cycle_rates", "J7",
    d.sql("""SELECT strftime(w, '%Y-%m-%dT%H:%M') AS window_start, count(*) AS publications, CAST(count(*) FILTER (event_id % 97 = 0 AND w + INTERVAL 5 MINUTE <= latest - INTERVAL 10 MINUTE) AS BIGINT) AS late
             FROM (SELECT event_id, time_bucket(INTERVAL 5 MINUTE, ts) AS w FROM log), (SELECT max(ts) AS latest FROM log WHERE event_id % 97 <> 0) GROUP BY 1"""),
)
def _(v):
    """A second batch holds rows of all times; most come behind the watermark of the first."""
    out = _run_folder(v)
    rows = v.log.select("event_id", "ts")
    log = _landed(v, f"{out}/in", [rows.filter("event_id % 97 <> 0").select("ts"), rows.filter("event_id % 97 = 0").select("ts")])
    J.rate_stream(log, out, 10, once=True).awaitTermination()
    return J.read_rates(v.spark, out).select(F.date_format("window_start", "yyyy-MM-dd'T'HH:mm").alias("window_start"), "publications", "late")


@query("requeued_posts", "J6", QUERIES["orphan_posts"].sql)
def _(v):
    """Leases and the batches that hold posts, as a stream up to now: its timers must give the orphans of the batch form."""
    out = _run_folder(v)
    analyzing = v.posts.filter("not is_deleted and processing_status = 'analyzing'")
    leased = F.col("analysis_lease_at")
    leases = analyzing.filter(leased.isNull() | (leased <= now()))
    leases = leases.select("post_id", F.coalesce(leased, F.lit(BASE).cast("timestamp")).alias("ts"), F.lit("lease").alias("kind"), leased.alias("leased_at"))
    active = _batches(v).filter("status in ('queued', 'processing')").select("batch_id")
    never = F.lit(None).cast("timestamp").alias("leased_at")
    held = v.batch_posts.join(active, "batch_id").join(leases.select("post_id"), "post_id").select("post_id", now().alias("ts"), F.lit("held").alias("kind"), never)
    beat = v.spark.range(1).select((-F.col("id") - 1).alias("post_id"), (now() + F.expr("interval 1 millisecond")).alias("ts"), F.lit("beat").alias("kind"), never)
    stream = J.requeue_stream(_landed(v, f"{out}/in", [leases, held.unionByName(beat)]))
    J._write(stream, f"{out}/rows", f"{out}/check", once=True).awaitTermination()
    return v.spark.read.parquet(f"{out}/rows").select("post_id")


@query(
    "sql_functions", "K3 H1 H2 H4",
    d.sql(f"""SELECT post_id, {d.noise('normalized_text')} AS reason, sha256(normalized_text) AS text_hash, {d.overlap('t', 'p')} AS overlap FROM (
              SELECT post_id, normalized_text, {d.words('normalized_text')} AS t, ['missile', 'attack', 'in', 'tehran'] AS p FROM posts)"""),
)
def _(v):
    S.register(v.spark)
    v.raw_posts.select("post_id", "original_text").createOrReplaceTempView("reports")
    return v.spark.sql(
        """SELECT post_id, noise_reason(n) AS reason, sha2(n, 256) AS text_hash, token_overlap(n, 'missile attack in Tehran') AS overlap
           FROM (SELECT post_id, normalize_text(original_text) AS n FROM reports)"""
    )


@query(
    "scored_pairs", "K1 C8",
    d.sql("SELECT batch_id, left_post_id, right_post_id, CASE WHEN confidence >= 0.25::DOUBLE THEN 'SAME_EVENT' ELSE 'DIFFERENT_EVENT' END AS relationship, confidence FROM overlap_rows",
          {**_RESOLVED, "sets": f"SELECT post_id, {d.words('normalized_text')} AS t FROM posts",
           "overlap_rows": f"SELECT p.batch_id, left_post_id, right_post_id, {d.overlap('a.t', 'b.t')} AS confidence FROM pairs p JOIN sets a ON a.post_id = left_post_id JOIN sets b ON b.post_id = right_post_id"}),
)
def _(v):
    """Judgments by a user function: how many words of the whole texts are shared."""

    def scorer(left, right):
        def judged(shared):
            same = F.when(shared >= 0.25, F.lit("SAME_EVENT")).otherwise(F.lit("DIFFERENT_EVENT"))
            return F.struct(same.alias("relationship"), shared.alias("confidence"))

        return let(set_overlap(left, right), judged)

    pairs = C.proposed_pairs(C.resolve_proposals(v.proposals, v.corrections, v.batch_posts))
    return C.judgments_from(pairs, v.posts, scorer, prepared=tokens)
