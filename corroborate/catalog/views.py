"""Engine tables derived from the given tables, for the registered queries.

The given tables lack the columns of a news log, so each view adds them by a
fixed rule over whole tables; ``duck.py`` states the same rules in SQL. Every
view grows with the tables it is derived from.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.functions.origin import cited_source
from corroborate.functions.text import noise_reason, normalize_text
from corroborate.functions.timefn import day_key
from corroborate.session import configure, derived_table, spread

# Phrases appended to the document texts so that keywords, attributions,
# denials and advertising occur; the last two are empty.
PHRASES = (
    "missile attack in Tehran",
    "dollar market in Iran",
    "according to Reuters",
    "officials denied it",
    "internet outage",
    "president election",
    "openai technology",
    "join our channel",
    "دلار و بازار ايران  ، مشهد",
    "به گزارش از خبرگزاری تسنیم در آمل",
    "مقام‌ها آن را تکذیب كردند !",
    "",
    "",
)
FORWARDS = ("@irna_1313", "Some  Channel", "reuters")
BASE = "2024-01-01"
NOW = "2024-01-01 10:30:00"
CATEGORY_CYCLE = ("WAR_SECURITY", "POLITICS", "ECONOMY", "SOCIETY", "WORLD", "TECHNOLOGY", "IRAN", "OTHER")
STATUS_CYCLE = ("CONFIRMED", "DEVELOPING", "DISPUTED", "UNVERIFIED")
STATE_CYCLE = ("published", "failed", "pending", "processing")
POST_STATES = ("embedding", "queued", "analyzing", "analyzed", "noise", "pending", "pending")
ACTION_CYCLE = (
    "NEW_EVENT", "MATCH_EXISTING_EVENT", "DUPLICATE", "NEW_EVENT", "UNCERTAIN",
    "NOISE", "UPDATE_EXISTING_EVENT", "DUPLICATE", "NEW_EVENT",
)
HTTP_CYCLE = (200, 200, 200, 200, 429, 502, 503, 504, 500, None)


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def pick(values, index: Column, cast: str = "string") -> Column:
    """The value at a 0-based position of a short tuple."""
    return F.element_at(F.array(*[F.lit(v).cast(cast) for v in values]), (index + 1).cast("int"))


def div(c: Column, n: int) -> Column:
    return F.floor(c / n)


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- documents ------------------------------------------------------------
    @cached_property
    def raw_posts(self) -> DataFrame:
        """Posts with raw text only.

        A given file is one row group, which is one task. Where files are
        fewer than cores rows are dealt out by id; only the columns a query needs are moved.
        """
        d = F.col("doc_id")
        seconds = div(d, 40) * 1500 + (d % 40) * 7
        phrase = pick(PHRASES, (d * 7 + div(d, 8) * 3 + div(d, 5)) % len(PHRASES))
        published = F.timestamp_seconds(F.unix_seconds(F.lit(BASE).cast("timestamp")) + seconds)
        return spread(self.table("documents"), "doc_id").select(
            "doc_id",
            (d + 1).alias("post_id"),
            (F.regexp_extract("source", "([0-9]+)", 1).cast("bigint") + 1).alias("source_id"),
            (d + 1).alias("message_id"),
            F.concat(F.lit("https://t.me/"), "source", F.lit("/"), (d + 1).cast("string")).alias("canonical_url"),
            published.alias("published_at"),
            (published + F.expr("interval 45 seconds")).alias("observed_at"),
            F.col("lang").alias("language"),
            F.concat("text", F.lit(" "), phrase).alias("original_text"),
        )

    @cached_property
    def posts(self) -> DataFrame:
        """Posts with clean text, flags, metadata and processing state.

        Most queries start from stored posts, which are derived once and then
        scanned: columns are pruned and flags pushed down as for any table.
        """
        return derived_table(self.spark, "posts", f"{self.folder}/documents.parquet", self._derive_posts)

    def _derive_posts(self) -> DataFrame:
        clean = self.raw_posts.withColumn("normalized_text", normalize_text(F.col("original_text")))
        clean = clean.withColumn("noise_reason", noise_reason(F.col("normalized_text")))
        d = F.col("doc_id")
        forwarded = F.when(d % 17 == 0, pick(FORWARDS, div(d, 17) % len(FORWARDS)))
        metadata = F.to_json(
            F.struct(forwarded.alias("forwarded_from"), cited_source(F.col("original_text")).alias("cited_source"))
        )
        return (
            clean.withColumns(
                {
                    "metadata": metadata,
                    "is_deleted": d % 29 == 0,
                    "is_noise": F.col("noise_reason").isNotNull(),
                    "processing_status": pick(POST_STATES, d % 7),
                    "analysis_content_hash": F.when(d % 2 == 0, F.sha2("normalized_text", 256)).otherwise(F.lit("x")),
                    "analysis_lease_at": F.when(
                        d % 3 != 0, F.timestamp_seconds(F.unix_seconds("observed_at") + (d % 25) * 60)
                    ),
                    "created_at": F.col("observed_at"),
                    "update_type": F.lit("create"),
                    "media_type": F.lit(None).cast("string"),
                }
            )
        )

    @cached_property
    def sources(self) -> DataFrame:
        """One row per channel."""
        n = F.col("source_id")
        keys = self.table("documents").select("source").distinct()
        named = keys.select(
            (F.regexp_extract("source", "([0-9]+)", 1).cast("bigint") + 1).alias("source_id"),
            F.col("source").alias("source_key"),
        )
        stamp = F.lit(NOW).cast("timestamp")
        return named.select(
            "source_id",
            "source_key",
            F.concat(F.lit("Channel "), n.cast("string")).alias("name"),
            F.concat(F.lit("chan_"), n.cast("string")).alias("username"),
            F.concat(F.lit("https://t.me/chan_"), n.cast("string")).alias("public_url"),
            pick(("primary_source", "authority_confirmation", "early_alert", "specialist", "aggregator"), n % 5).alias("role"),
            pick(("TIER_1", "TIER_2", "TIER_3"), n % 3).alias("priority_tier"),
            F.lit("IRAN").alias("category"),
            F.lit("en").alias("language"),
            F.lit("news").alias("source_type"),
            (F.lit(0.35) + F.lit(0.05) * (n % 7)).alias("trust_score"),
            (n % 2 == 0).alias("is_wire_origin"),
            (n % 4 != 0).alias("is_active"),
            pick(("healthy", "degraded", "pending_validation"), n % 3).alias("health_status"),
            F.when(n % 5 != 0, stamp - F.make_dt_interval(mins=(n - 9).cast("int"))).alias("next_poll_at"),
            F.when(n % 6 != 0, stamp - F.make_dt_interval(hours=n.cast("int"))).alias("last_polled_at"),
            F.when(n % 3 != 0, n * 20).alias("last_seen_message_id"),
            F.when(n % 3 == 1, F.concat(F.lit("http_"), (n + 400).cast("string"))).alias("last_error"),
        )

    @cached_property
    def links(self) -> DataFrame:
        """Which event a post was attached to, and when."""
        d = F.col("_first")
        event = div(d, 12) * 12 + F.floor((d % 12) / (1 + div(d, 12) % 4)) + 1
        posts = self.raw_posts.join(self._first_copies, "doc_id")
        return posts.select(event.alias("event_id"), "post_id", F.col("observed_at").alias("attached_at"))

    @cached_property
    def _first_copies(self) -> DataFrame:
        """The first document with the same text, for every document: copies report the same event."""
        named = self.table("documents").select("doc_id", F.md5("text").alias("_text"))
        return named.join(named.groupBy("_text").agg(F.min("doc_id").alias("_first")), "_text").drop("_text")

    @cached_property
    def crowded_links(self) -> DataFrame:
        """Posts attached to one event per language, so every event is crowded."""
        lang = F.col("language")
        event = F.when(lang == "en", 1).when(lang == "fr", 2).when(lang == "de", 3).otherwise(4).cast("bigint")
        return self.raw_posts.select(event.alias("event_id"), "post_id", F.col("observed_at").alias("attached_at"))

    @cached_property
    def events(self) -> DataFrame:
        """Scored-event inputs, one per document."""
        d = F.col("doc_id")
        return self.raw_posts.select(
            F.col("post_id").alias("event_id"),
            (1 + d % 3).alias("event_version"),
            F.col("original_text").alias("core_fact"),
            pick(CATEGORY_CYCLE, d % len(CATEGORY_CYCLE)).alias("category"),
            pick(STATUS_CYCLE, div(d, 7) % len(STATUS_CYCLE)).alias("verification_status"),
            (d % 5).alias("independent_confirmation_count"),
            (d % 6 + 1).alias("source_count"),
            F.col("published_at").alias("first_seen_at"),
            F.timestamp_seconds(F.unix_seconds("published_at") + (d % 50) * 600).alias("last_updated_at"),
            F.when(d % 3 == 0, F.lit("closed")).otherwise(F.lit("active")).alias("event_state"),
            (d % 2 == 0).alias("high_priority"),
        )

    @cached_property
    def judgments(self) -> DataFrame:
        """Editor judgments for the documents that carry labels."""
        d = F.col("doc_id")
        return self.table("labels").select(
            (d + 1).alias("event_id"),
            (1 + d % 3).alias("event_version"),
            F.when(F.col("toxic") == 1, F.lit("IGNORE")).when(F.col("quality") == 1, F.lit("PUBLISH")).otherwise(F.lit("MONITOR")).alias("recommendation"),
            (d % 46 - 20).cast("int").alias("adjustment"),
            F.lit("judged").alias("reason"),
            (d % 2 == 1).alias("breaking"),
        )

    @cached_property
    def stories(self) -> DataFrame:
        """Stories for the documents that carry labels, two documents to an event."""
        d = F.col("doc_id")
        at = F.timestamp_seconds(F.unix_seconds(F.lit(BASE).cast("timestamp")) + div(d, 40) * 1500 + (d % 40) * 7)
        state = pick(STATE_CYCLE, d % 4)
        event, version = div(d, 2) + 1, F.col("quality") + 1
        return self.table("labels").select(
            (d + 1).alias("story_id"),
            event.alias("event_id"),
            version.cast("bigint").alias("event_version"),
            F.concat(F.lit("event:"), event.cast("string"), F.lit(":version:"), version.cast("string"), F.lit(":"), (d % 2).cast("string")).alias("publish_key"),
            F.concat(F.lit("Story "), (d + 1).cast("string")).alias("title"),
            pick(STATUS_CYCLE, div(d, 3) % 4).alias("verification_status"),
            (d % 4).alias("independent_confirmations"),
            state.alias("publication_state"),
            F.when(state == "published", at).alias("published_at"),
            at.alias("created_at"),
            F.timestamp_seconds(F.unix_seconds(at) + (d % 9) * 60).alias("updated_at"),
            F.when(d % 8 != 0, d + 1000).alias("message_id"),
            F.when(state == "failed", F.lit("send_failed")).alias("last_error"),
        )

    @cached_property
    def candidates(self) -> DataFrame:
        """Editorial candidates, one per document."""
        d = F.col("doc_id")
        return self.raw_posts.select(
            F.col("post_id").alias("event_id"),
            (1 + d % 2).alias("event_version"),
            pick(("PUBLISH", "PUBLISH", "MONITOR", "IGNORE"), div(d, 3) % 4).alias("decision"),
            (60 + d % 40).alias("score"),
            pick(("pending", "failed", "update_pending", "queued", "update_failed"), d % 5).alias("status"),
            F.col("published_at").alias("created_at"),
            F.date_format("published_at", "yyyy-MM-dd").alias("day"),
        )

    # -- batches --------------------------------------------------------------
    @cached_property
    def batch_posts(self) -> DataFrame:
        return self.raw_posts.select(div(F.col("doc_id"), 32).alias("batch_id"), "post_id", F.col("original_text").alias("text"))

    def _partition(self, broken: Column) -> DataFrame:
        """A proposed partition of every batch, some of them broken on purpose."""
        d, b, r = F.col("doc_id"), F.col("batch_id"), F.col("doc_id") % 32
        cluster = F.floor(r / (2 + F.col("batch_id") % 4))
        rows = self.raw_posts.select("doc_id", div(d, 32).alias("batch_id"), "post_id")
        rows = rows.withColumn("cluster_no", cluster)
        ids = F.sort_array(F.collect_list("post_id"))
        grouped = rows.groupBy("batch_id", "cluster_no").agg(ids.alias("post_ids"))
        fault = F.when(broken, b % 9).otherwise(F.lit(-1))
        c = F.col("cluster_no")
        post_ids = (
            F.when((fault == 4) & (c == 1), F.slice("post_ids", 1, 1))
            .when((fault == 5) & (c == 0), F.concat("post_ids", F.array(b * 32 + 8)))
            .when((fault == 6) & (c == 2), F.concat("post_ids", F.array(F.lit(999_999_999).cast("bigint"))))
            .otherwise(F.col("post_ids"))
        )
        kind = F.when((c + b) % 7 == 3, F.lit("NOISE")).when((c + b) % 11 == 5, F.lit("UNCERTAIN")).otherwise(F.lit("EVENT"))
        confidence = F.when((fault == 7) & (c == 0), F.lit(2.0)).otherwise((F.lit(90) + (c + b) % 10) / F.lit(100.0))
        return grouped.select("batch_id", "cluster_no", post_ids.alias("post_ids"), kind.alias("classification"), confidence.alias("confidence"))

    @cached_property
    def proposals(self) -> DataFrame:
        return self._partition(F.lit(True))

    @cached_property
    def corrections(self) -> DataFrame:
        """Second answers; those of odd batches repeat the fault."""
        return self._partition(F.col("batch_id") % 2 == 1)

    @cached_property
    def pair_judgments(self) -> DataFrame:
        """Judgments of posts at most five ids apart in the same batch."""
        near = self.batch_posts.select("batch_id", F.col("post_id").alias("left_post_id"), F.explode(F.sequence(F.col("post_id") + 1, F.col("post_id") + 5)).alias("right_post_id"))
        left, right = F.col("left_post_id"), F.col("right_post_id")
        return near.filter("floor((right_post_id - 1) / 32) = batch_id").select(
            "batch_id",
            "left_post_id",
            "right_post_id",
            pick(("SAME_EVENT", "SAME_EVENT", "SAME_EVENT", "DIFFERENT_EVENT", "UNCERTAIN"), (left * 7 + right * 3) % 5).alias("relationship"),
            ((F.lit(92) + (left + right) % 8) / F.lit(100.0)).alias("confidence"),
        )

    @cached_property
    def decisions(self) -> DataFrame:
        """Decisions over pairs of posts, one in five batches broken."""
        d, b = F.col("doc_id"), F.col("batch_id")
        rows = self.raw_posts.select(
            div(d, 32).alias("batch_id"), div(d % 32, 2).alias("decision_no"), "post_id"
        )
        grouped = rows.groupBy("batch_id", "decision_no").agg(F.sort_array(F.collect_list("post_id")).alias("post_ids"))
        n = F.col("decision_no")
        first = F.col("post_ids")[0]
        action = pick(ACTION_CYCLE, (n + b) % len(ACTION_CYCLE))
        fault = b % 10
        target = F.when(action == "DUPLICATE", F.when((first + 2) < (b + 1) * 32, first + 2).otherwise(b * 32 + 1))
        target = F.when((fault == 3) & (action == "DUPLICATE"), F.lit(999_999_999).cast("bigint")).otherwise(target)
        event = F.when(action.isin("MATCH_EXISTING_EVENT", "UPDATE_EXISTING_EVENT"), div(first - 1, 4) + 1)
        event = F.when((fault == 1) & (n == 4), F.lit(7).cast("bigint")).otherwise(event)
        post_ids = F.when((fault == 5) & (n == 2), F.concat("post_ids", F.array(b * 32 + 1))).when((fault == 7) & (n == 1), F.slice("post_ids", 1, 1)).otherwise(F.col("post_ids"))
        confidence = F.when((fault == 9) & (n == 0), F.lit(1.5)).otherwise((F.lit(60) + (n * 7 + b) % 40) / F.lit(100.0))
        return grouped.select(
            "batch_id",
            "decision_no",
            post_ids.alias("post_ids"),
            action.alias("action"),
            event.alias("event_id"),
            target.alias("duplicate_of_post_id"),
            confidence.alias("confidence"),
            F.lit("fact").alias("canonical_fact"),
            F.lit("IRAN").alias("category"),
            F.lit("reason").alias("reason"),
        )

    @cached_property
    def history(self) -> DataFrame:
        """Stored event of every post."""
        return self.raw_posts.select("post_id", (div(F.col("doc_id"), 3) + 1).alias("event_id"))

    # -- events table ---------------------------------------------------------
    @cached_property
    def log(self) -> DataFrame:
        """The events table with instants in UTC and integer amounts."""
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
            "cents", F.floor(F.col("value") * 100 + 0.5)
        )

    @cached_property
    def calls(self) -> DataFrame:
        """Model calls."""
        e, u, cents = F.col("event_id"), F.col("user_id"), F.col("cents")
        return self.log.select(
            e.alias("call_id"),
            "ts",
            day_key(F.col("ts")).alias("day"),
            F.col("event_type").alias("stage"),
            F.lit(500).alias("cost"),
            div(e, 3).alias("request_id"),
            (e % 3 + 1).alias("logical_attempt"),
            u.alias("batch_id"),
            pick(HTTP_CYCLE, cents % 10, "int").alias("status"),
            cents.alias("latency_ms"),
            (cents % 700).alias("prompt_tokens"),
            F.when(cents % 11 != 0, cents % 90).alias("completion_tokens"),
            F.when(u % 8 != 0, F.concat(F.lit("p"), (u % 4).cast("string"))).alias("provider"),
            F.when(u % 7 != 0, F.concat(F.lit("m"), (u % 5).cast("string"))).alias("routed_model"),
            (e % 2).alias("fallback_attempts"),
            (u % 33).alias("report_count"),
            (e % 41).alias("active_event_count"),
            (cents % 5000).alias("prompt_chars"),
            (cents % 300).alias("schema_chars"),
            (cents % 6 != 0).alias("structured"),
            (cents % 5 != 0).alias("schema_valid"),
            (cents % 4 != 0).alias("contract_valid"),
            pick(("", "timeout", "structured_json_invalid", "rate_limit", "auth_failed", "provider_error", "schema_invalid", "model-unavailable"), cents % 8).alias("error_code"),
            (cents % 3).alias("missing_posts"),
            (2000 * (1 + u % 5)).alias("max_tokens"),
        )

    @cached_property
    def polls(self) -> DataFrame:
        """Polls of the channels."""
        e, u = F.col("event_id"), F.col("user_id")
        ok = F.col("event_type") != "error"
        return self.log.select(
            (u % 20 + 1).alias("source_id"),
            F.col("ts").alias("polled_at"),
            e.alias("poll_id"),
            ok.alias("ok"),
            F.when(ok & (F.col("event_type") != "signup"), e + F.col("cents") % 50).alias("latest_id"),
            F.when(ok, e + F.col("cents") % 7).alias("earliest_id"),
            F.when(~ok, F.concat(F.lit("http_"), (F.col("cents") % 600).cast("string"))).alias("error"),
        )

    @cached_property
    def envelopes(self) -> DataFrame:
        """Ingest envelopes: creates, edits and deletes of the same messages."""
        e, u, cents = F.col("event_id"), F.col("user_id"), F.col("cents")
        kind = F.col("event_type")
        update = F.when(kind == "error", F.lit("delete")).when(kind == "click", F.lit("edit")).otherwise(F.lit("create"))
        return self.log.select(
            e.alias("seq"),
            (u % 20 + 1).alias("source_id"),
            (e % 2003 + 1).alias("message_id"),
            update.alias("update_type"),
            F.concat(F.lit("https://t.me/c/"), (e % 2003 + 1).cast("string")).alias("canonical_url"),
            F.when(kind != "view", F.col("ts")).alias("published_at"),
            F.when(kind == "click", F.col("ts")).alias("edited_at"),
            F.col("ts").alias("observed_at"),
            F.lit("en").alias("language"),
            F.concat(F.lit(" text "), (cents % 40).cast("string")).alias("text"),
            F.sha2((cents % 3).cast("string"), 256).alias("content_hash"),
            F.when(cents % 4 == 0, F.lit("photo")).alias("media_type"),
            F.lit("<div>").alias("raw_html_snippet"),
            F.lit("{}").alias("metadata"),
        )

    @cached_property
    def stored_posts(self) -> DataFrame:
        """Stored state of the messages whose document carries a label."""
        d = F.col("doc_id")
        at = F.lit(BASE).cast("timestamp")
        return self.table("labels").select(
            (d % 20 + 1).alias("source_id"),
            (d % 2003 + 1).alias("message_id"),
            F.lit("https://t.me/c/old").alias("canonical_url"),
            F.lit("create").alias("update_type"),
            F.when(F.col("quality") == 1, at).alias("published_at"),
            F.lit(None).cast("timestamp").alias("edited_at"),
            at.alias("observed_at"),
            F.lit("en").alias("language"),
            F.lit(" old text").alias("original_text"),
            F.lit("old text").alias("normalized_text"),
            F.sha2((d % 3).cast("string"), 256).alias("content_hash"),
            F.when(d % 2 == 0, F.lit("video")).alias("media_type"),
            F.lit("<p>").alias("raw_html_snippet"),
            F.lit("{}").alias("metadata"),
            (F.col("toxic") == 1).alias("is_deleted"),
            F.lit(False).alias("is_noise"),
            F.lit(None).cast("string").alias("noise_reason"),
            F.lit("analyzed").alias("processing_status"),
            F.lit("h").alias("analysis_content_hash"),
            at.alias("analysis_lease_at"),
            F.lit(2).alias("analysis_attempts"),
            at.alias("created_at"),
            at.alias("updated_at"),
        )

    # -- pages ----------------------------------------------------------------
    @cached_property
    def channel_pages(self) -> DataFrame:
        """Landed pages: ten posts of one channel to a page, in marker HTML."""
        d = F.col("doc_id")
        text = F.replace(F.replace(F.replace("original_text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br/>"))
        time = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
        forward = F.when(d % 17 == 0, F.lit('<a class="tgme_widget_message_forwarded_from_name" href="https://t.me/irna_1313/5">x</a>')).otherwise(F.lit(""))
        media = F.when(d % 4 == 1, F.lit('<a class="tgme_widget_message_photo_wrap"></a>')).when(d % 4 == 2, F.lit('<i class="tgme_widget_message_video"></i>')).otherwise(F.lit(""))
        edited = F.when(d % 6 == 0, F.lit("<span>edited</span>")).otherwise(F.lit(""))
        message = F.concat(
            F.lit('<div class="m" data-post="chan/'), F.col("post_id").cast("string"), F.lit('">'), forward, media,
            F.lit('<div class="tgme_widget_message_text js">'), text, F.lit('</div><time datetime="'), time, F.lit('"></time>'), edited, F.lit("</div>"),
        )
        pages = self.raw_posts.select(
            div(d, 200).alias("_g"), (d % 20).alias("_s"), F.struct("post_id", message.alias("m")).alias("x")
        ).groupBy("_g", "_s").agg(F.array_sort(F.collect_list("x")).alias("xs"))
        return pages.select(
            (F.col("_s") + 1).alias("source_id"),
            F.concat(F.lit("src"), F.col("_s").cast("string")).alias("source_key"),
            F.lit("chan").alias("username"),
            F.concat(F.lit("https://t.me/s/chan?"), F.col("_g").cast("string")).alias("url"),
            F.concat(
                F.lit('<html class="tgme_page_widget">'),
                F.array_join(F.transform("xs", lambda x: x["m"]), ""),
                F.lit("</html>"),
            ).alias("html"),
            F.lit(NOW).cast("timestamp").alias("fetched_at"),
        )
