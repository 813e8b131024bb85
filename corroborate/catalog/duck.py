"""The views of ``views.py`` and the text rules as SQL for the oracle.

SQL here is written independently of the Spark expressions: other functions,
RE2 instead of Java patterns, and plain windows where Spark runs in blocks.
"""

from __future__ import annotations

import re

from corroborate.catalog import views as V
from corroborate.functions import origin as O
from corroborate.functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def cycle(values, index: str) -> str:
    items = ", ".join("NULL" if v is None else (q(v) if isinstance(v, str) else str(v)) for v in values)
    return f"([{items}])[({index}) + 1]"


def has(expr: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({expr}, {q(pattern)}, 'i'), false)"


def trim(expr: str) -> str:
    return f"regexp_replace({expr}, {q(f'^[{T.SPACES}]+|[{T.SPACES}]+$')}, '', 'g')"


def flat(expr: str) -> str:
    return trim(f"regexp_replace({expr}, {q(f'[{T.SPACES}]+')}, ' ', 'g')")


def norm(expr: str) -> str:
    folded = f"translate({expr}, {q(T.FOLD_FROM)}, {q(T.FOLD_TO)})"
    blanks = f"regexp_replace({folded}, {q('[\t\r\n ]+')}, ' ', 'g')"
    closed = f"regexp_replace({blanks}, {q(f'[{T.SPACES}]+([{T.PUNCTUATION}])')}, '\\1', 'g')"
    return trim(closed)


def noise(expr: str) -> str:
    return (
        f"CASE WHEN coalesce({expr}, '') = '' THEN 'empty' WHEN length({expr}) < 18 THEN 'too_short' "
        f"WHEN {has(expr, '|'.join(T.NOISE_PATTERNS))} THEN 'promotion_or_advertisement' END"
    )


def words(expr: str, least: int = 2) -> str:
    """Distinct lower-case tokens of an already normalized text."""
    return (
        f"list_distinct(list_filter(regexp_split_to_array(lower({expr}), '[^\\p{{L}}\\p{{N}}]+'), "
        f"lambda w: length(w) >= {least}))"
    )


def overlap(a: str, b: str) -> str:
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE "
        f"len(list_intersect({a}, {b}))::DOUBLE / greatest(len({a}), len({b})) END"
    )


def first_hit(expr: str, patterns, otherwise: str = "NULL") -> str:
    ladder = " ".join(f"WHEN {has(expr, p)} THEN {q(name)}" for name, p in patterns)
    return f"CASE {ladder} ELSE {otherwise} END"


def all_hits(expr: str, patterns) -> str:
    items = ", ".join(f"CASE WHEN {has(expr, p)} THEN {q(name)} END" for name, p in patterns)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def re2(pattern: str) -> str:
    """Spelled-out ASCII boundaries as RE2's \\b, which is ASCII as well."""
    for guard in ("(?<!" + O._WORD + ")", "(?!" + O._WORD + ")", "(?<=" + O._WORD + ")", "(?=" + O._WORD + ")"):
        pattern = pattern.replace(guard, r"\b")
    return pattern


def cited(expr: str) -> str:
    patterns = [(name, re2(p)) for name, p in O.CITED_PATTERNS]
    return f"CASE WHEN {has(expr, O.ATTRIBUTION)} THEN {first_hit(expr, patterns)} END"


def fold(expr: str) -> str:
    folded = (
        f"regexp_replace(regexp_replace(lower({trim(expr)}), '^@', ''), {q(f'[{T.SPACES}_-]+')}, '_', 'g')"
    )
    ladder = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in O.ORIGIN_ALIASES)
    return f"(CASE {folded} {ladder} ELSE left({folded}, 80) END)"


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def half_up(expr: str, digits: int = 0) -> str:
    scale = f"{10**digits}.0::DOUBLE"
    return f"(floor(({expr}) * {scale} + 0.5::DOUBLE) / {scale})"


BASE, NOW = f"TIMESTAMP '{V.BASE}'", f"TIMESTAMP '{V.NOW}'"
AT = f"({BASE} + to_seconds((doc_id // 40) * 1500 + (doc_id % 40) * 7))"

VIEWS = {
    "raw_posts": f"""
        SELECT doc_id, doc_id + 1 AS post_id, CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) + 1 AS source_id,
               doc_id + 1 AS message_id, 'https://t.me/' || source || '/' || (doc_id + 1) AS canonical_url,
               {AT} AS published_at, {AT} + INTERVAL 45 SECOND AS observed_at, lang AS language,
               text || ' ' || {cycle(V.PHRASES, f"(doc_id * 7 + doc_id // 8 * 3 + doc_id // 5) % {len(V.PHRASES)}")} AS original_text
        FROM documents""",
    "posts": f"""
        SELECT *, noise_reason IS NOT NULL AS is_noise,
               CASE WHEN doc_id % 2 = 0 THEN sha256(normalized_text) ELSE 'x' END AS analysis_content_hash
        FROM (SELECT *, {noise("normalized_text")} AS noise_reason, doc_id % 29 = 0 AS is_deleted,
                     {cycle(V.POST_STATES, "doc_id % 7")} AS processing_status,
                     CASE WHEN doc_id % 3 <> 0 THEN observed_at + to_minutes(doc_id % 25) END AS analysis_lease_at,
                     observed_at AS created_at,
                     CASE WHEN doc_id % 17 = 0 THEN {cycle(V.FORWARDS, "(doc_id // 17) % 3")} END AS forwarded_from,
                     {cited("original_text")} AS cited_source
              FROM (SELECT *, {norm("original_text")} AS normalized_text FROM raw_posts))""",
    "sources": f"""
        SELECT n AS source_id, source AS source_key, 'Channel ' || n AS name, 'chan_' || n AS username,
               {cycle(("primary_source", "authority_confirmation", "early_alert", "specialist", "aggregator"), "n % 5")} AS role,
               {cycle(("TIER_1", "TIER_2", "TIER_3"), "n % 3")} AS priority_tier,
               0.35::DOUBLE + 0.05::DOUBLE * (n % 7) AS trust_score, n % 2 = 0 AS is_wire_origin, n % 4 <> 0 AS is_active,
               {cycle(("healthy", "degraded", "pending_validation"), "n % 3")} AS health_status,
               CASE WHEN n % 5 <> 0 THEN {NOW} - to_minutes(n - 9) END AS next_poll_at,
               CASE WHEN n % 6 <> 0 THEN {NOW} - to_hours(n) END AS last_polled_at,
               CASE WHEN n % 3 <> 0 THEN n * 20 END AS last_seen_message_id,
               CASE WHEN n % 3 = 1 THEN 'http_' || (n + 400) END AS last_error
        FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) + 1 AS n FROM documents)""",
    "links": """
        SELECT f // 12 * 12 + (f % 12) // (1 + f // 12 % 4) + 1 AS event_id, post_id, observed_at AS attached_at
        FROM raw_posts JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) USING (doc_id)""",
    "crowded_links": """
        SELECT CASE language WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END AS event_id, post_id,
               observed_at AS attached_at FROM raw_posts""",
    "event_rows": f"""
        SELECT post_id AS event_id, 1 + doc_id % 3 AS event_version, original_text AS core_fact,
               {cycle(V.CATEGORY_CYCLE, f"doc_id % {len(V.CATEGORY_CYCLE)}")} AS category,
               {cycle(V.STATUS_CYCLE, "(doc_id // 7) % 4")} AS verification_status,
               doc_id % 5 AS independent_confirmation_count, doc_id % 6 + 1 AS source_count,
               published_at AS first_seen_at, published_at + to_seconds((doc_id % 50) * 600) AS last_updated_at,
               CASE WHEN doc_id % 3 = 0 THEN 'closed' ELSE 'active' END AS event_state, doc_id % 2 = 0 AS high_priority
        FROM raw_posts""",
    "judgments": """
        SELECT doc_id + 1 AS event_id, 1 + doc_id % 3 AS event_version,
               CASE WHEN toxic = 1 THEN 'IGNORE' WHEN quality = 1 THEN 'PUBLISH' ELSE 'MONITOR' END AS recommendation,
               doc_id % 46 - 20 AS adjustment, 'judged' AS reason, doc_id % 2 = 1 AS breaking FROM labels""",
    "stories": f"""
        SELECT doc_id + 1 AS story_id, doc_id // 2 + 1 AS event_id, quality + 1 AS event_version,
               'event:' || (doc_id // 2 + 1) || ':version:' || (quality + 1) || ':' || (doc_id % 2) AS publish_key,
               'Story ' || (doc_id + 1) AS title, {cycle(V.STATUS_CYCLE, "(doc_id // 3) % 4")} AS verification_status,
               doc_id % 4 AS independent_confirmations, {cycle(V.STATE_CYCLE, "doc_id % 4")} AS publication_state,
               CASE WHEN doc_id % 4 = 0 THEN {AT} END AS published_at, {AT} AS created_at,
               {AT} + to_minutes(doc_id % 9) AS updated_at, CASE WHEN doc_id % 8 <> 0 THEN doc_id + 1000 END AS message_id,
               CASE WHEN doc_id % 4 = 1 THEN 'send_failed' END AS last_error FROM labels""",
    "candidates": f"""
        SELECT post_id AS event_id, 1 + doc_id % 2 AS event_version,
               {cycle(("PUBLISH", "PUBLISH", "MONITOR", "IGNORE"), "(doc_id // 3) % 4")} AS decision,
               60 + doc_id % 40 AS score,
               {cycle(("pending", "failed", "update_pending", "queued", "update_failed"), "doc_id % 5")} AS status,
               published_at AS created_at, strftime(published_at, '%Y-%m-%d') AS day FROM raw_posts""",
    "batch_posts": "SELECT doc_id // 32 AS batch_id, post_id, original_text AS text FROM raw_posts",
    "sound_partition": """
        SELECT batch_id, cluster_no, list(post_id ORDER BY post_id) AS post_ids,
               CASE WHEN (cluster_no + batch_id) % 7 = 3 THEN 'NOISE' WHEN (cluster_no + batch_id) % 11 = 5 THEN 'UNCERTAIN' ELSE 'EVENT' END AS classification,
               (90 + (cluster_no + batch_id) % 10)::DOUBLE / 100.0::DOUBLE AS confidence
        FROM (SELECT doc_id // 32 AS batch_id, post_id, (doc_id % 32) // (2 + (doc_id // 32) % 4) AS cluster_no FROM raw_posts)
        GROUP BY batch_id, cluster_no""",
    "proposals": """
        SELECT batch_id, cluster_no, CASE
                 WHEN batch_id % 9 = 4 AND cluster_no = 1 THEN post_ids[1:1]
                 WHEN batch_id % 9 = 5 AND cluster_no = 0 THEN list_append(post_ids, batch_id * 32 + 8)
                 WHEN batch_id % 9 = 6 AND cluster_no = 2 THEN list_append(post_ids, 999999999)
                 ELSE post_ids END AS post_ids, classification,
               CASE WHEN batch_id % 9 = 7 AND cluster_no = 0 THEN 2.0::DOUBLE ELSE confidence END AS confidence
        FROM sound_partition""",
    "corrections": """
        SELECT s.batch_id, s.cluster_no, CASE WHEN s.batch_id % 2 = 1 THEN p.post_ids ELSE s.post_ids END AS post_ids,
               s.classification, CASE WHEN s.batch_id % 2 = 1 THEN p.confidence ELSE s.confidence END AS confidence
        FROM sound_partition s JOIN proposals p USING (batch_id, cluster_no)""",
    "pair_judgments": f"""
        SELECT batch_id, l AS left_post_id, r AS right_post_id,
               {cycle(("SAME_EVENT", "SAME_EVENT", "SAME_EVENT", "DIFFERENT_EVENT", "UNCERTAIN"), "(l * 7 + r * 3) % 5")} AS relationship,
               (92 + (l + r) % 8)::DOUBLE / 100.0::DOUBLE AS confidence
        FROM (SELECT batch_id, post_id AS l, unnest(range(post_id + 1, post_id + 6)) AS r FROM batch_posts)
        WHERE (r - 1) // 32 = batch_id""",
    "decisions": f"""
        SELECT batch_id, decision_no,
               CASE WHEN batch_id % 10 = 5 AND decision_no = 2 THEN list_append(post_ids, batch_id * 32 + 1)
                    WHEN batch_id % 10 = 7 AND decision_no = 1 THEN post_ids[1:1] ELSE post_ids END AS post_ids, action,
               CASE WHEN batch_id % 10 = 1 AND decision_no = 4 THEN 7
                    WHEN action IN ('MATCH_EXISTING_EVENT', 'UPDATE_EXISTING_EVENT') THEN (f - 1) // 4 + 1 END AS event_id,
               CASE WHEN action = 'DUPLICATE' THEN CASE WHEN batch_id % 10 = 3 THEN 999999999
                    WHEN f + 2 < (batch_id + 1) * 32 THEN f + 2 ELSE batch_id * 32 + 1 END END AS duplicate_of_post_id,
               CASE WHEN batch_id % 10 = 9 AND decision_no = 0 THEN 1.5::DOUBLE
                    ELSE (60 + (decision_no * 7 + batch_id) % 40)::DOUBLE / 100.0::DOUBLE END AS confidence
        FROM (SELECT batch_id, decision_no, list(post_id ORDER BY post_id) AS post_ids, min(post_id) AS f,
                     {cycle(V.ACTION_CYCLE, f"(decision_no + batch_id) % {len(V.ACTION_CYCLE)}")} AS action
              FROM (SELECT doc_id // 32 AS batch_id, (doc_id % 32) // 2 AS decision_no, post_id FROM raw_posts)
              GROUP BY batch_id, decision_no)""",
    "decision_posts": """
        SELECT batch_id, decision_no, action, event_id, duplicate_of_post_id, confidence, unnest(post_ids) AS post_id,
               unnest(range(len(post_ids))) AS pos FROM decisions""",
    "history": "SELECT post_id, doc_id // 3 + 1 AS event_id FROM raw_posts",
    "log": "SELECT *, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM events",
    "calls": f"""
        SELECT event_id AS call_id, ts, strftime(ts, '%Y-%m-%d') AS day, event_type AS stage, 500 AS cost,
               event_id // 3 AS request_id, event_id % 3 + 1 AS logical_attempt, user_id AS batch_id,
               {cycle(V.HTTP_CYCLE, "cents % 10")} AS status, cents AS latency_ms, cents % 700 AS prompt_tokens,
               CASE WHEN cents % 11 <> 0 THEN cents % 90 END AS completion_tokens,
               CASE WHEN user_id % 8 <> 0 THEN 'p' || (user_id % 4) END AS provider,
               CASE WHEN user_id % 7 <> 0 THEN 'm' || (user_id % 5) END AS routed_model,
               event_id % 2 AS fallback_attempts, user_id % 33 AS report_count, event_id % 41 AS active_event_count,
               cents % 5000 AS prompt_chars, cents % 300 AS schema_chars, cents % 6 <> 0 AS structured,
               cents % 5 <> 0 AS schema_valid, cents % 4 <> 0 AS contract_valid,
               {cycle(("", "timeout", "structured_json_invalid", "rate_limit", "auth_failed", "provider_error", "schema_invalid", "model-unavailable"), "cents % 8")} AS error_code,
               cents % 3 AS missing_posts, 2000 * (1 + user_id % 5) AS max_tokens
        FROM log""",
    "polls": """
        SELECT user_id % 20 + 1 AS source_id, ts AS polled_at, event_id AS poll_id, event_type <> 'error' AS ok,
               CASE WHEN event_type NOT IN ('error', 'signup') THEN event_id + cents % 50 END AS latest_id,
               CASE WHEN event_type <> 'error' THEN event_id + cents % 7 END AS earliest_id,
               CASE WHEN event_type = 'error' THEN 'http_' || (cents % 600) END AS error FROM log""",
    "envelopes": """
        SELECT event_id AS seq, user_id % 20 + 1 AS source_id, event_id % 2003 + 1 AS message_id,
               CASE event_type WHEN 'error' THEN 'delete' WHEN 'click' THEN 'edit' ELSE 'create' END AS update_type,
               CASE WHEN event_type <> 'view' THEN ts END AS published_at, CASE WHEN event_type = 'click' THEN ts END AS edited_at,
               ts AS observed_at, ' text ' || (cents % 40) AS text, sha256((cents % 3)::VARCHAR) AS content_hash,
               CASE WHEN cents % 4 = 0 THEN 'photo' END AS media_type FROM log""",
    "stored_posts": f"""
        SELECT doc_id % 20 + 1 AS source_id, doc_id % 2003 + 1 AS message_id,
               CASE WHEN quality = 1 THEN {BASE} END AS published_at, {BASE} AS observed_at,
               sha256((doc_id % 3)::VARCHAR) AS content_hash, CASE WHEN doc_id % 2 = 0 THEN 'video' END AS media_type,
               toxic = 1 AS is_deleted FROM labels""",
}


def group_of(post: str = "p", source: str = "s") -> str:
    """Origin group of a report that copies nothing."""
    return (
        f"CASE WHEN {post}.forwarded_from IS NOT NULL THEN 'origin:' || {fold(post + '.forwarded_from')} "
        f"WHEN {post}.cited_source IS NOT NULL THEN 'origin:' || {fold(post + '.cited_source')} "
        f"WHEN {source}.is_wire_origin THEN 'origin:' || {source}.source_key ELSE 'source:' || {source}.source_id END"
    )


KIND = (
    "CASE WHEN p.forwarded_from IS NOT NULL THEN 'forward_repost' WHEN p.cited_source IS NOT NULL THEN 'wire_republish' "
    "WHEN s.is_wire_origin OR s.role = 'primary_source' THEN 'original_reporting' "
    "WHEN s.role IN ('aggregator', 'early_alert') THEN 'aggregation' ELSE 'unknown' END"
)

VIEWS["evidence"] = f"""
    SELECT l.event_id, l.post_id, l.attached_at, s.source_id, s.name, s.priority_tier, s.trust_score, p.canonical_url,
           p.normalized_text AS text, t.origin_group, {KIND} AS origin_type
    FROM links l JOIN posts p USING (post_id) JOIN sources s ON s.source_id = p.source_id
    JOIN links_traced t ON t.event_id = l.event_id AND t.post_id = l.post_id"""


def lineage_sql(links: str) -> dict[str, str]:
    """Views that follow every report to the one whose origin it takes (recursive)."""
    return {
        f"{links}_base": f"""
            SELECT l.event_id, l.post_id, {group_of()} AS own_group, {KIND} AS kind, c.parent_post_id,
                   CASE WHEN p.forwarded_from IS NULL AND p.cited_source IS NULL THEN c.parent_post_id END AS up
            FROM {links} l JOIN posts p USING (post_id) JOIN sources s ON s.source_id = p.source_id
            LEFT JOIN {links}_copies c ON c.event_id = l.event_id AND c.post_id = l.post_id""",
        f"{links}_walk": f"""
            SELECT event_id, post_id, own_group, 0 AS depth, up FROM {links}_base UNION ALL
            SELECT w.event_id, w.post_id, b.own_group, depth + 1, b.up FROM {links}_walk w
            JOIN {links}_base b ON b.event_id = w.event_id AND b.post_id = w.up""",
        f"{links}_traced": f"""
            SELECT w.event_id, w.post_id, w.own_group AS origin_group, b.kind AS origin_type,
                   CASE WHEN b.parent_post_id IS NOT NULL THEN 0.9::DOUBLE WHEN b.kind = 'unknown' THEN 0.55::DOUBLE ELSE 0.8::DOUBLE END AS relationship_confidence
            FROM {links}_walk w JOIN {links}_base b ON b.event_id = w.event_id AND b.post_id = w.post_id WHERE w.up IS NULL""",
    }


def copies_sql(links: str) -> str:
    """Latest of the thirty rows before each row of its event that it copies."""
    return f"""
        SELECT a.event_id, a.post_id, arg_max(b.post_id, b.n) AS parent_post_id
        FROM {links}_tokens a JOIN {links}_tokens b ON a.event_id = b.event_id AND a.n - b.n BETWEEN 1 AND 30
        WHERE least(len(a.t), len(b.t)) >= greatest(len(a.t), len(b.t)) * 0.86::DOUBLE AND {overlap("a.t", "b.t")} >= 0.86::DOUBLE
        GROUP BY a.event_id, a.post_id"""


for _links in ("links", "crowded_links"):
    VIEWS[f"{_links}_tokens"] = f"""
        SELECT l.event_id, l.post_id, {words("p.normalized_text")} AS t,
               row_number() OVER (PARTITION BY l.event_id ORDER BY l.attached_at, l.post_id) AS n
        FROM {_links} l JOIN posts p USING (post_id)"""
    VIEWS[f"{_links}_copies"] = copies_sql(_links)
    VIEWS.update(lineage_sql(_links))


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the views it needs, in dependency order."""
    known = {**VIEWS, **(extra or {})}
    order: list[str] = []
    open_: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in order and name not in open_ and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                open_.append(name)
                need(known[name])
                order.append(name)

    need(body)
    loops = {name for name in order if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", known[name])}
    parts = ",\n".join(f"{name} AS {'' if name in loops else 'MATERIALIZED '}({known[name]})" for name in order)
    if not parts:
        return body
    return f"WITH {'RECURSIVE ' if loops else ''}{parts}\n{body}"
