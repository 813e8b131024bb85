"""Registered queries over quotas, telemetry, feeds and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.catalog import duck as d
from corroborate.catalog.registry import query
from corroborate.catalog.views import now
from corroborate.config import Limits
from corroborate.operators import evaluate as E
from corroborate.operators import ops as O
from corroborate.operators import quota as Q
from corroborate.operators.editorial import score_events
from corroborate.streaming import rates

# --- quotas ------------------------------------------------------------------
CAPS = {"error": 40, "click": 60, "view": 0, "signup": 1400}
_CAP = "CASE stage WHEN 'error' THEN 40 WHEN 'click' THEN 60 WHEN 'view' THEN 0 WHEN 'signup' THEN 1400 ELSE 0 END"


def caps():
    pairs = F.create_map(*[F.lit(x) for pair in CAPS.items() for x in pair])
    return F.try_element_at(pairs, F.col("stage"))


@query(
    "admit_calls", "E3",
    d.sql(f"SELECT call_id, position, {_CAP} > 0 AND position <= {_CAP} AS admitted FROM (SELECT *, row_number() OVER (PARTITION BY day, stage ORDER BY ts, call_id) AS position FROM calls)"),
)
def _(v):
    return Q.admit_calls(v.calls, caps()).select("call_id", "position", "admitted")


@query(
    "admit_costs", "E4",
    d.sql(f"""SELECT call_id, ok AND sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) <= 8000 // 500 AS admitted FROM (
              SELECT *, {_CAP} > 0 AND row_number() OVER (PARTITION BY day, stage ORDER BY ts, call_id) <= {_CAP} AS ok FROM calls)"""),
)
def _(v):
    return Q.admit_costs(v.calls, 500, 8_000, caps()).select("call_id", "admitted")


_MIXED = {
    "bids": f"SELECT call_id, day, stage, (call_id % 7) * 150 - 100 AS cost, {_CAP} AS cap, row_number() OVER (PARTITION BY day ORDER BY ts, call_id) AS i FROM calls",
    "ledger": """SELECT DISTINCT day, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS call_id, CAST(0 AS BIGINT) AS spent, MAP {'': 0} AS used, false AS admitted FROM bids
        UNION ALL SELECT b.day, b.i, b.call_id, CASE WHEN ok THEN f.spent + b.cost ELSE f.spent END, CASE WHEN ok THEN map_concat(f.used, MAP {b.stage: n + 1}) ELSE f.used END, ok
        FROM (SELECT f.*, b.i AS _i, b.cost > 0 AND b.cost <= 8000 AND coalesce(f.used[b.stage], 0) < b.cap AND f.spent + b.cost <= 8000 AS ok, coalesce(f.used[b.stage], 0) AS n
              FROM ledger f JOIN bids b ON b.day = f.day AND b.i = f.i + 1) f JOIN bids b ON b.day = f.day AND b.i = f._i""",
}


@query("admit_mixed_costs", "E4", d.sql("SELECT call_id, admitted FROM ledger WHERE i > 0", _MIXED))
def _(v):
    calls = v.calls.withColumn("cost", F.col("call_id") % 7 * 150 - 100)
    return Q.admit_mixed_costs(calls, 8_000, caps()).select("call_id", "admitted")


@query(
    "backfill_budget", "A13",
    d.sql("""SELECT coalesce(u.day, l.day) AS usage_date, greatest(coalesce(u.cost, 0), coalesce(l.cost, 0)) AS cost FROM
             (SELECT day, CAST(sum(cost) AS BIGINT) AS cost FROM calls GROUP BY 1) u FULL JOIN (SELECT day, CAST(sum(score * 100) AS BIGINT) AS cost FROM candidates GROUP BY 1) l ON u.day = l.day"""),
)
def _(v):
    usage = v.calls.groupBy(F.col("day").alias("usage_date"), "stage").agg(F.sum("cost").alias("cost"), F.max("ts").alias("updated_at"))
    ledger = v.candidates.groupBy(F.col("day").alias("usage_date")).agg(F.sum(F.col("score") * 100).alias("cost"), F.max("created_at").alias("updated_at"))
    return Q.backfill_budget(usage, ledger).select("usage_date", "cost")


@query("usage_by_stage", "D10", d.sql("SELECT day, stage, count(*) AS calls, CAST(sum(cost) AS BIGINT) AS cost FROM calls GROUP BY 1, 2"))
def _(v):
    return Q.usage_by_stage(v.calls)


@query("stories_on_day", "D4", d.sql("SELECT count(*) AS stories FROM stories WHERE publication_state = 'published' AND strftime(published_at, '%Y-%m-%d') = '2024-01-01'"))
def _(v):
    return Q.stories_on(v.stories, "2024-01-01")


_AT = "greatest(coalesce(published_at, updated_at), coalesce(updated_at, published_at))"
_START = "TIMESTAMP '2024-01-01 01:00:00'"


def start():
    return F.lit("2024-01-01 01:00:00").cast("timestamp")


_RATES = f"""SELECT count(*) AS total, count(*) FILTER (a >= {d.NOW} - INTERVAL 1 HOUR) AS hourly, count(*) FILTER (a >= time_bucket(INTERVAL 5 MINUTE, {d.NOW}) AND a < time_bucket(INTERVAL 5 MINUTE, {d.NOW}) + INTERVAL 5 MINUTE) AS cycle
    FROM (SELECT {_AT} AS a FROM stories) WHERE a >= {_START}"""


@query("publication_rates", "D5", d.sql(_RATES))
def _(v):
    return Q.publication_rates(v.stories, start(), now())


@query("limiter_decision", "E5 D5", d.sql(f"""SELECT *, reason = 'allowed' AS allowed FROM (SELECT *, CASE WHEN total >= 5 THEN 'canary_total_exhausted' WHEN hourly >= 2 THEN 'canary_hour_exhausted' WHEN cycle >= 1 THEN 'canary_cycle_exhausted' ELSE 'allowed' END AS reason FROM (SELECT count(*) AS total, count(*) FILTER (a >= {d.NOW} - INTERVAL 1 HOUR) AS hourly, count(*) FILTER (a >= time_bucket(INTERVAL 5 MINUTE, {d.NOW}) AND a < time_bucket(INTERVAL 5 MINUTE, {d.NOW}) + INTERVAL 5 MINUTE) AS cycle
    FROM (SELECT {_AT} AS a FROM stories) WHERE a >= {_START}))"""))
def _(v):
    return Q.limiter_decision(v.stories, start(), now())


@query(
    "replay_limiter", "E5 J7",
    d.sql(f"""SELECT story_id, total, hourly, cycle, CASE WHEN total >= 100 THEN 'canary_total_exhausted' WHEN hourly >= 20 THEN 'canary_hour_exhausted' WHEN cycle >= 9 THEN 'canary_cycle_exhausted' ELSE 'allowed' END AS reason FROM (
        SELECT story_id, count(*) OVER (ORDER BY a RANGE UNBOUNDED PRECEDING) AS total, count(*) OVER (ORDER BY a RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS hourly,
               count(*) OVER (PARTITION BY time_bucket(INTERVAL 5 MINUTE, a) ORDER BY a RANGE UNBOUNDED PRECEDING) AS cycle FROM (SELECT *, {_AT} AS a FROM stories) WHERE a >= {_START})"""),
)
def _(v):
    limits = Limits(publish_total=100, publish_per_hour=20, publish_per_cycle=9)
    return Q.replay_limiter(v.stories, start(), limits).select("story_id", "total", "hourly", "cycle", "reason")


_OFFERS = f"SELECT story_id, channel, a, row_number() OVER (PARTITION BY channel ORDER BY a, story_id) AS i FROM (SELECT story_id, 'c' || story_id % 3 AS channel, epoch_us({_AT}) AS a FROM stories) WHERE a >= epoch_us({_START})"
_FOLD = """
    SELECT DISTINCT channel, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS story_id, CAST([] AS BIGINT[]) AS times, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS hourly, CAST(0 AS BIGINT) AS cycle, '' AS reason FROM offers
    UNION ALL SELECT channel, i, story_id, CASE WHEN total < 60 AND hourly < 4 AND cycle < 2 THEN list_append(times, a) ELSE times END, total, hourly, cycle,
        CASE WHEN total >= 60 THEN 'canary_total_exhausted' WHEN hourly >= 4 THEN 'canary_hour_exhausted' WHEN cycle >= 2 THEN 'canary_cycle_exhausted' ELSE 'allowed' END
    FROM (SELECT f.times, o.channel, o.i, o.story_id, o.a, len(f.times) AS total, len(list_filter(f.times, lambda t: t >= o.a - 3600000000)) AS hourly, len(list_filter(f.times, lambda t: t >= o.a - o.a % 300000000)) AS cycle
          FROM limited f JOIN offers o ON o.channel = f.channel AND o.i = f.i + 1)"""


@query(
    "admit_publications", "E5",
    d.sql("""SELECT 'on' AS mode, s.story_id, coalesce(total, 0) AS total, coalesce(hourly, 0) AS hourly, coalesce(cycle, 0) AS cycle, coalesce(reason, 'before_start') AS reason, coalesce(reason = 'allowed', false) AS allowed
             FROM stories s LEFT JOIN (SELECT * FROM limited WHERE i > 0) l ON l.story_id = s.story_id
             UNION ALL SELECT 'off', story_id, 0, 0, 0, 'canary_disabled', true FROM stories UNION ALL SELECT 'invalid', story_id, 0, 0, 0, 'canary_configuration_invalid', false FROM stories""",
          {"offers": _OFFERS, "limited": _FOLD}),
)
def _(v):
    offers = v.stories.select("story_id", F.concat(F.lit("c"), F.col("story_id") % 3).alias("channel"), Q.activity_time().alias("at"), F.col("story_id").alias("candidate_id"))
    limits = Limits(publish_total=60, publish_per_hour=4, publish_per_cycle=2)
    modes = {
        "on": Q.admit_publications(offers, start(), limits),
        "off": Q.admit_publications(offers, start(), limits, enabled=False),
        "invalid": Q.admit_publications(offers, start(), Limits(publish_total=0)),
    }
    rows = [run.select(F.lit(mode).alias("mode"), "story_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "hourly", "cycle")], "reason", "allowed") for mode, run in modes.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "reservation_stats", "D13 K2",
    d.sql("""SELECT batch_id, attempts, reserved, attempts - reserved AS blocked, retries, greatest(0, attempts - 50) AS truncated,
             CASE WHEN reserved >= 1250 THEN 'CRITICAL' WHEN reserved >= 1100 THEN 'HIGH' ELSE 'none' END AS usage_signal
             FROM (SELECT batch_id % 5 AS batch_id, count(*) AS attempts, count(*) FILTER (structured) AS reserved, count(*) FILTER (logical_attempt > 1) AS retries FROM calls GROUP BY 1)"""),
)
def _(v):
    rows = v.calls.select(
        (F.col("batch_id") % 5).alias("batch_id"),
        F.when(F.col("structured"), F.lit("RESERVED")).otherwise(F.lit("BUDGET_BLOCKED")).alias("reservation"),
        (F.col("logical_attempt") > 1).alias("retry"),
    )
    return Q.reservation_stats(rows, 50).withColumn("usage_signal", F.coalesce("usage_signal", F.lit("none")))


@query(
    "reservation_entries", "D13",
    d.sql("SELECT batch, entry_no, call_id, structured FROM (SELECT batch_id % 5 AS batch, call_id, structured, row_number() OVER (PARTITION BY batch_id % 5 ORDER BY ts, call_id) AS entry_no FROM calls) WHERE entry_no <= 50"),
)
def _(v):
    rows = v.calls.select((F.col("batch_id") % 5).alias("batch_id"), "call_id", "ts", "structured")
    kept = Q.reservation_entries(rows, ["ts", "call_id"], 50)
    return kept.select(F.col("batch_id").alias("batch"), F.col("entry_no").cast("bigint").alias("entry_no"), "call_id", "structured")


# --- operations --------------------------------------------------------------
@query("daily_counters", "D3 H34", d.sql("SELECT strftime(ts, '%Y-%m-%d') AS counter_date, event_type AS metric, CAST(sum(cents) AS BIGINT) AS value FROM log GROUP BY 1, 2"))
def _(v):
    return O.counters(v.log.select("ts", F.col("event_type").alias("metric"), F.col("cents").alias("amount")))


@query("registry_totals", "D9", d.sql("SELECT count(*) AS total, count(*) FILTER (is_active) AS active FROM sources"))
def _(v):
    return O.registry_totals(v.sources)


@query(
    "batch_telemetry", "D11",
    d.sql("""SELECT batch_id, count(*) AS physical_attempts, count(*) FILTER (status = 200) AS http_200, count(*) FILTER (status = 429) AS http_429, count(*) FILTER (status = 502) AS http_502,
             count(*) FILTER (status = 503) AS http_503, count(*) FILTER (status = 504) AS http_504, count(*) FILTER (status BETWEEN 500 AND 599 AND status NOT IN (502, 503, 504)) AS other_5xx,
             count(*) FILTER (status IS NULL) AS transport_failures, count(*) FILTER (logical_attempt > 1) AS retries, count(*) FILTER (logical_attempt > 1 AND status = 200) AS retry_recoveries,
             CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens, CAST(sum(latency_ms) AS BIGINT) AS latency_ms, max(latency_ms) AS max_latency_ms FROM calls GROUP BY 1"""),
)
def _(v):
    return O.batch_telemetry(v.calls)


_OK = "coalesce(status BETWEEN 200 AND 299, false)"


@query(
    "provider_distribution", "D14",
    d.sql(f"SELECT coalesce(provider, 'unknown') AS provider, count(*) AS calls, count(*) FILTER ({_OK}) AS success, count(*) FILTER (NOT {_OK}) AS failure, count(*) FILTER ({_OK} AND fallback_attempts > 0) AS fallback_wins FROM calls GROUP BY 1"),
)
def _(v):
    return O.provider_distribution(v.calls)


@query("routed_models", "D14", d.sql("SELECT routed_model, count(*) AS calls FROM calls WHERE routed_model IS NOT NULL GROUP BY 1"))
def _(v):
    return O.routed_models(v.calls)


_MEDIANS = ", ".join(f"{d.half_up(f'median({m}::DOUBLE)', 2)} AS median_{m}" for m in O.MEASURES)


@query(
    "provider_behavior", "D15",
    d.sql(f"SELECT coalesce(provider, 'unknown') AS provider, count(*) AS requests, CAST(sum(fallback_attempts) AS BIGINT) AS fallback_attempts, string_agg(DISTINCT routed_model, ',' ORDER BY routed_model) AS routed_models, {_MEDIANS} FROM calls WHERE {_OK} GROUP BY 1"),
)
def _(v):
    return O.provider_behavior(v.calls)


@query(
    "latency_summary", "D16",
    d.sql(f"""SELECT stage, count(*) AS samples, {d.half_up('median(latency_ms::DOUBLE)', 2)} AS median, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, max(latency_ms) AS maximum,
              {d.half_up('CAST(sum(latency_ms) AS BIGINT)::DOUBLE / count(*)', 2)} AS average FROM calls GROUP BY 1"""),
)
def _(v):
    return O.latency_summary(v.calls, ["stage"])


@query(
    "overview", "D24",
    d.sql(f"""SELECT s.*, c.*, u.* FROM (SELECT count(*) AS sources_total, count(*) FILTER (is_active) AS sources_active, count(*) FILTER (health_status <> 'healthy') AS sources_degraded, {d.iso('max(last_polled_at)')} AS latest_poll_at FROM sources) s,
        (SELECT coalesce(CAST(sum(cents) FILTER (event_type = 'view') AS BIGINT), 0) AS posts_observed, coalesce(CAST(sum(cents) FILTER (event_type = 'click') AS BIGINT), 0) AS raw_posts_persisted, 0 AS events_created, 0 AS events_scored,
                coalesce(CAST(sum(cents) FILTER (event_type = 'purchase') AS BIGINT), 0) AS stories_published, 0 AS poll_envelopes_queued, coalesce(CAST(sum(cents) FILTER (event_type = 'error') AS BIGINT), 0) AS queue_failures FROM log WHERE strftime(ts, '%Y-%m-%d') = '2024-01-02') c,
        (SELECT count(*) AS ai_calls, coalesce(CAST(sum(cost) AS BIGINT), 0) AS ai_cost FROM calls WHERE day = '2024-01-02') u"""),
)
def _(v):
    names = {"view": "posts_observed", "click": "raw_posts_persisted", "purchase": "stories_published", "error": "queue_failures"}
    renamed = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("event_type"))
    counts = O.counters(v.log.select("ts", F.coalesce(renamed, F.lit("other")).alias("metric"), F.col("cents").alias("amount")))
    return O.overview(v.sources, counts, Q.usage_by_stage(v.calls), "2024-01-02")


@query("latest_posts", "F2", d.sql("SELECT post_id FROM raw_posts ORDER BY coalesce(published_at, observed_at) DESC, post_id DESC LIMIT 60"))
def _(v):
    return O.latest(v.raw_posts, F.coalesce("published_at", "observed_at"), "post_id", 60).select("post_id")


_CUT = lambda x, n: f"CASE WHEN length({d.flat(x)}) > {n} THEN left({d.flat(x)}, {n - 1}) || '…' ELSE {d.flat(x)} END"


def _feed_sql() -> str:
    from corroborate.catalog.event_queries import _SCORED

    return d.sql(
        f"""SELECT id, kind, {d.iso('ts')} AS ts, title, detail, tone FROM (
        SELECT * FROM (SELECT 'post-' || post_id AS id, 'post' AS kind, observed_at AS ts, s.name || ' / message ' || message_id AS title, {_CUT('original_text', 180)} AS detail,
            CASE WHEN is_noise THEN 'muted' ELSE 'cyan' END AS tone FROM posts p JOIN sources s USING (source_id) ORDER BY published_at DESC, post_id DESC LIMIT 30)
        UNION ALL SELECT * FROM (SELECT 'event-' || event_id || '-v' || event_version, 'event', last_updated_at, verification_status || ' · ' || {_CUT('core_fact', 120)},
            source_count || ' sources · score ' || importance_score, CASE verification_status WHEN 'CONFIRMED' THEN 'lime' WHEN 'DISPUTED' THEN 'coral' ELSE 'amber' END FROM scored ORDER BY last_updated_at DESC, event_id DESC LIMIT 20)
        UNION ALL SELECT * FROM (SELECT 'story-' || story_id, 'publish', coalesce(published_at, created_at), CASE WHEN publication_state = 'published' THEN 'Story published' ELSE 'Story ' || publication_state END,
            CASE WHEN last_error IS NOT NULL THEN title || ' · ' || last_error ELSE title END, CASE publication_state WHEN 'published' THEN 'lime' WHEN 'failed' THEN 'coral' ELSE 'amber' END FROM stories ORDER BY coalesce(published_at, created_at) DESC, story_id DESC LIMIT 20)
        UNION ALL SELECT * FROM (SELECT 'source-' || source_id || '-' || coalesce({d.iso('last_polled_at')}, 'unknown'), 'source', coalesce(last_polled_at, TIMESTAMP '1970-01-01'), name || ' · ' || health_status, last_error, 'coral'
            FROM sources WHERE last_error IS NOT NULL ORDER BY is_active DESC, health_status, source_id LIMIT 10)) ORDER BY ts DESC, kind, id LIMIT 60""",
        _SCORED,
    )


@query("activity_feed", "F3 G1 H23", _feed_sql())
def _(v):
    posts = v.posts.join(v.sources.select("source_id", F.col("name").alias("source_name")), "source_id")
    return O.activity(posts, score_events(v.events, now()), v.stories, v.sources)


# --- evaluation --------------------------------------------------------------
_MEMBERS = {
    "grouping": "SELECT *, action || ':' || coalesce(event_id::VARCHAR, 'new:' || decision_no) AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, post_id ORDER BY decision_no DESC) AS latest FROM decision_posts) WHERE latest = 1",
    "compared": """SELECT d.batch_id, d.decision_no, d.action, NOT (d.action = 'UNCERTAIN' OR d.confidence < 0.72::DOUBLE) AS sure, h.n, coalesce(h.hit, false) AS hit
        FROM decisions d LEFT JOIN (SELECT batch_id, decision_no, count(DISTINCT h.event_id) AS n, bool_or(coalesce(h.event_id = p.event_id, false)) AS hit
             FROM decision_posts p JOIN history h USING (post_id) GROUP BY 1, 2) h USING (batch_id, decision_no)""",
    "agreed": """SELECT *, sure AND action IN ('MATCH_EXISTING_EVENT', 'UPDATE_EXISTING_EVENT') AND n = 1 AND hit OR sure AND action = 'DUPLICATE' AND n = 1 AS existing, sure AND action = 'NEW_EVENT' AND coalesce(n, 0) <= 1 AS fresh,
        sure AND action IN ('MATCH_EXISTING_EVENT', 'UPDATE_EXISTING_EVENT', 'DUPLICATE', 'NOISE') AND NOT coalesce(action IN ('MATCH_EXISTING_EVENT', 'UPDATE_EXISTING_EVENT') AND n = 1 AND hit OR action = 'DUPLICATE' AND n = 1, false) AS against,
        sure AND coalesce(n, 0) > 1 AS merged FROM compared""",
}


@query("agreement", "D20", d.sql("SELECT batch_id, decision_no, coalesce(existing, false) AS existing_agreement, fresh AS new_agreement, against AS disagreement, merged AS false_merge FROM agreed", _MEMBERS))
def _(v):
    return E.agreement(v.decisions, v.history).select("batch_id", "decision_no", "existing_agreement", "new_agreement", "disagreement", "false_merge")


@query(
    "agreement_totals", "D20",
    d.sql(f"""SELECT *, {d.half_up('existing_event_agreements::DOUBLE / nullif(existing_event_agreements + disagreements, 0)', 4)} AS agreement_rate FROM (SELECT count(*) FILTER (existing) AS existing_event_agreements, count(*) FILTER (fresh) AS new_event_agreements,
              count(*) FILTER (against) + count(*) FILTER (merged) AS disagreements, count(*) FILTER (merged) AS false_merge_candidates FROM agreed)""", _MEMBERS),
)
def _(v):
    return E.agreement_totals(E.agreement(v.decisions, v.history))


@query("false_splits", "D21", d.sql("""SELECT b.batch_id, h.event_id, count(DISTINCT coalesce(p.predicted, '-')) AS groups, count(*) AS posts FROM batch_posts b JOIN history h USING (post_id)
             LEFT JOIN grouping p ON p.batch_id = b.batch_id AND p.post_id = b.post_id GROUP BY 1, 2 HAVING count(DISTINCT coalesce(p.predicted, '-')) > 1""", _MEMBERS))
def _(v):
    return E.false_splits(v.batch_posts, v.decisions, v.history)


_FA, _LA = "regexp_matches({}.text, '[؀-ۿ]')", "regexp_matches({}.text, '[A-Za-z]')"


@query(
    "cross_language_pairs", "C16",
    d.sql(f"""SELECT DISTINCT a.batch_id, a.post_id AS left_post_id, b.post_id AS right_post_id, CASE WHEN a.predicted IS NOT DISTINCT FROM b.predicted THEN 'grouped' ELSE 'separated' END AS result
              FROM rows_ a JOIN rows_ b ON a.batch_id = b.batch_id AND a.event_id = b.event_id AND a.post_id < b.post_id
              WHERE ({_FA.format('a')} AND {_LA.format('b')}) OR ({_LA.format('a')} AND {_FA.format('b')})""",
          {**_MEMBERS, "rows_": "SELECT b.batch_id, b.post_id, b.text, h.event_id, g.predicted FROM batch_posts b JOIN history h USING (post_id) LEFT JOIN grouping g ON g.batch_id = b.batch_id AND g.post_id = b.post_id"}),
)
def _(v):
    return E.cross_language_pairs(v.batch_posts, v.history, v.decisions)


@query(
    "copied_source_cases", "D22",
    d.sql("""SELECT batch_id, event_id, count(DISTINCT source_id) AS sources, count(DISTINCT origin_group) AS origins FROM (SELECT (post_id - 1) // 32 AS batch_id, * FROM evidence)
             GROUP BY 1, 2 HAVING count(DISTINCT source_id) >= 2 AND count(DISTINCT origin_group) BETWEEN 1 AND count(DISTINCT source_id) - 1"""),
)
def _(v):
    from corroborate.catalog.event_queries import _evidence

    rows = _evidence(v).withColumn("batch_id", F.floor((F.col("post_id") - 1) / 32))
    return E.copied_source_cases(rows)


_REVIEW = f"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3 AND w NOT IN ({', '.join(d.q(w) for w in __import__('corroborate.functions.text', fromlist=['x']).STOP_WORDS)})))"


@query(
    "shared_terms", "G4",
    d.sql("""SELECT group_id, term, row_number() OVER (PARTITION BY group_id ORDER BY term) AS term_no FROM (SELECT group_id, term FROM terms JOIN (SELECT event_id AS group_id, count(*) AS size FROM links GROUP BY 1) USING (group_id)
             WHERE size > 1 GROUP BY group_id, term, size HAVING count(*) = size) QUALIFY term_no <= 12""",
          {"terms": f"SELECT l.event_id AS group_id, unnest({_REVIEW.replace('text', 'p.original_text')}) AS term FROM links l JOIN raw_posts p USING (post_id)"}),
)
def _(v):
    members = v.links.join(v.raw_posts.select("post_id", F.col("original_text").alias("text")), "post_id").withColumnRenamed("event_id", "group_id")
    return E.shared_terms(members)


@query("span_hours", "H33", d.sql(f"SELECT event_id AS group_id, {d.half_up('(epoch_us(max(attached_at)) - epoch_us(min(attached_at)))::DOUBLE / 3600000000.0::DOUBLE', 3)} AS span_hours FROM links GROUP BY 1"))
def _(v):
    return E.span_hours(v.links.select(F.col("event_id").alias("group_id"), F.col("attached_at").alias("seen_at")))


_CASES = """SELECT batch_id, decision_no, CASE WHEN merged THEN 'false_merges' WHEN against THEN 'disagreements' WHEN existing OR fresh THEN 'agreements' END AS category FROM agreed"""


@query(
    "review_samples", "F9",
    d.sql("""SELECT category, batch_id, case_key, sample_no FROM (SELECT category, batch_id, decision_no AS case_key, row_number() OVER (PARTITION BY category ORDER BY batch_id, decision_no) AS sample_no FROM cases WHERE category IS NOT NULL)
             WHERE sample_no <= CASE category WHEN 'false_merges' THEN 20 ELSE 10 END""", {**_MEMBERS, "cases": _CASES}),
)
def _(v):
    c = E.agreement(v.decisions, v.history)
    category = (
        F.when(F.col("false_merge"), F.lit("false_merges"))
        .when(F.col("disagreement"), F.lit("disagreements"))
        .when(F.col("existing_agreement") | F.col("new_agreement"), F.lit("agreements"))
    )
    cases = c.select(category.alias("category"), "batch_id", F.col("decision_no").alias("case_key")).filter("category is not null")
    return E.review_samples(cases, {"false_merges": 20})


@query("rejected_responses", "D23", d.sql("SELECT error_code AS rejection_code, count(*) AS responses FROM calls WHERE error_code <> '' GROUP BY 1"))
def _(v):
    return E.rejected_responses(v.calls.withColumn("rejection_code", F.nullif("error_code", F.lit(""))))


_REQUESTS = f"""SELECT request_id, CASE WHEN request_id % 4 = 0 THEN 'second_pass' ELSE 'primary' END AS kind, arg_min(structured AND {_OK}, logical_attempt) AS first_won,
    arg_min(coalesce(status, -1), logical_attempt) AS first_status, arg_max(structured AND {_OK}, logical_attempt) AS last_won, count(*) AS n FROM calls GROUP BY 1, 2"""


@query(
    "run_metrics", "D23",
    d.sql(f"""SELECT *, {d.half_up('initial_successes::DOUBLE / nullif(initial_requests, 0)', 4)} AS initial_success_rate FROM (SELECT count(*) AS logical_requests, count(*) FILTER (kind = 'primary') AS initial_requests,
        count(*) FILTER (kind = 'primary' AND first_won) AS initial_successes, count(*) FILTER (kind = 'primary' AND NOT first_won) AS initial_failures, count(*) FILTER (kind = 'primary' AND first_status = 502) AS initial_http_502,
        CAST(sum(n - 1) AS BIGINT) AS retry_calls, count(*) FILTER (n > 1 AND last_won) AS retry_successes, count(*) FILTER (n > 1 AND NOT last_won) AS retry_failures FROM requests)""", {"requests": _REQUESTS}),
)
def _(v):
    kind = F.when(F.col("request_id") % 4 == 0, F.lit("second_pass")).otherwise(F.lit("primary"))
    return E.run_metrics(v.calls.select("request_id", kind.alias("kind"), F.col("logical_attempt").alias("attempt"), "status", "structured"))


@query(
    "benchmark_summary", "D17",
    d.sql(f"""SELECT coalesce(routed_model, 'none') AS model, count(*) AS requests, count(*) FILTER (status = 200) AS http, count(*) FILTER (structured) AS json, count(*) FILTER (schema_valid) AS schema_ok, count(*) FILTER (contract_valid) AS contract_ok,
        count(*) FILTER (contract_valid AND missing_posts = 0) AS full_coverage, {d.half_up('CAST(sum(completion_tokens) AS BIGINT)::DOUBLE / nullif(count(completion_tokens), 0)', 2)} AS average_completion_tokens,
        quantile_disc(latency_ms, 0.5) AS median_latency_ms, quantile_disc(latency_ms, 0.95) AS p95_latency_ms, max(latency_ms) AS max_latency_ms FROM calls GROUP BY 1"""),
)
def _(v):
    samples = v.calls.withColumn("model", F.coalesce("routed_model", F.lit("none"))).withColumn("json_valid", F.col("structured"))
    return E.benchmark_summary(samples)


@query("action_histogram", "D17", d.sql("SELECT batch_id, action, count(*) AS samples FROM decisions GROUP BY 1, 2"))
def _(v):
    return E.histogram(v.decisions, ["batch_id"], "action")


_CEILINGS = """SELECT max_tokens, count(*) AS requests, count(*) FILTER (status BETWEEN 200 AND 299) AS http_success, count(*) FILTER (schema_valid) AS schema_ok, count(*) FILTER (status = 502) AS terminal_502,
    count(*) FILTER (status BETWEEN 500 AND 599) AS terminal_5xx, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS total_completion_tokens FROM calls GROUP BY 1"""


@query("token_ceilings", "D18", d.sql("SELECT *, http_success = requests AND schema_ok = requests AS reliable FROM ceilings", {"ceilings": _CEILINGS}))
def _(v):
    return E.ceiling_summary(v.calls)


@query(
    "smallest_reliable_ceiling", "D18",
    d.sql("SELECT min(max_tokens) AS max_tokens FROM (SELECT latency_ms % 97 AS max_tokens, bool_and(schema_valid OR latency_ms % 97 > 40) AS ok FROM calls GROUP BY 1) WHERE ok"),
)
def _(v):
    """Ceilings by latency class; statuses are taken as good, schemas as good above class 40."""
    c = F.col("latency_ms") % 97
    rows = v.calls.select(c.alias("max_tokens"), F.lit(200).alias("status"), (F.col("schema_valid") | (c > 40)).alias("schema_valid"), "completion_tokens")
    return E.smallest_reliable(E.ceiling_summary(rows))


@query(
    "contract_audit", "D19",
    d.sql("""SELECT kind, key, count(*) AS decisions FROM (
        SELECT 'missing' AS kind, unnest(['event_id', 'duplicate_of_post_id', 'confidence', 'canonical_fact', 'category', 'reason']) AS key FROM documents WHERE doc_id % 3 = 0
        UNION ALL SELECT 'extra', 'note' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'action', 'NOISE' FROM documents WHERE doc_id % 3 = 0
        UNION ALL SELECT 'wrong_type', unnest(['post_ids:string', 'confidence:string']) FROM documents WHERE doc_id % 3 = 1
        UNION ALL SELECT 'shape', 'complete' FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT 'action', 'NEW_EVENT' FROM documents WHERE doc_id % 3 = 1
        UNION ALL SELECT 'missing', unnest(['post_ids', 'action', 'event_id', 'duplicate_of_post_id', 'confidence', 'canonical_fact', 'category', 'reason']) FROM documents WHERE doc_id % 3 = 2
        UNION ALL SELECT 'action', '[invalid/missing]' FROM documents WHERE doc_id % 3 = 2) GROUP BY 1, 2"""),
)
def _(v):
    n = F.col("doc_id")
    quoted = F.regexp_replace(F.regexp_replace(F.to_json(F.struct(F.col("text").alias("t"))), '^\\{"t":', ""), "\\}$", "")
    one = (
        F.when(n % 3 == 0, F.concat(F.lit('{"post_ids":[1],"action":"NOISE","note":'), quoted, F.lit("}")))
        .when(
            n % 3 == 1,
            F.concat(F.lit('{"post_ids":"1","action":"NEW_EVENT","event_id":null,"duplicate_of_post_id":2,"confidence":"high","canonical_fact":'), quoted, F.lit(',"category":"IRAN","reason":"r"}')),
        )
        .otherwise(F.lit("[]"))
    )
    rows = v.table("documents").select(n.alias("response_id"), F.concat(F.lit('{"decisions":['), one, F.lit("]}")).alias("output"))
    return E.contract_audit(rows)


@query(
    "gateway_attempts", "H45 H28",
    d.sql("""SELECT call_id, 'p' || (latency_ms % 4) AS provider, 'm/' || (latency_ms % 5) AS model, CASE WHEN latency_ms % 3 = 0 THEN 502 ELSE 429 END AS status, 'c' || (latency_ms % 6) AS error_code FROM calls"""),
)
def _(v):
    from corroborate.functions.jsonfn import gateway_attempts

    x = F.col("latency_ms")
    attempt = F.to_json(
        F.struct(
            F.concat(F.lit("p"), (x % 4).cast("string"), F.lit("/m/"), (x % 5).cast("string")).alias("routed_via"),
            F.when(x % 3 == 0, F.lit(502)).otherwise(F.lit(429)).alias("status"),
            F.struct(F.concat(F.lit("c"), (x % 6).cast("string")).alias("code")).alias("error"),
        )
    )
    body = F.concat(F.lit('{"error":{"attempts":['), attempt, F.lit("]}}"))
    rows = v.calls.select("call_id", F.explode(gateway_attempts(body)).alias("a"))
    return rows.select("call_id", "a.provider", "a.model", "a.status", "a.error_code")


# --- rates over time ---------------------------------------------------------
@query(
    "sliding_rates", "J7",
    d.sql("""SELECT strftime(w, '%Y-%m-%dT%H:%M') AS window_start, count(*) AS publications FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(unnest(range(12)) * 5) AS w FROM log) GROUP BY 1"""),
)
def _(v):
    hourly = rates.sliding_rates(v.log.select("ts"))
    return hourly.select(F.date_format("window_start", "yyyy-MM-dd'T'HH:mm").alias("window_start"), "publications")


@query("cycle_rates", "J7", d.sql("SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%dT%H:%M') AS window_start, count(*) AS publications FROM log GROUP BY 1"))
def _(v):
    return rates.cycle_rates(v.log.select("ts")).select(F.date_format("window_start", "yyyy-MM-dd'T'HH:mm").alias("window_start"), "publications")
