"""Registered queries from proposals to verified, scored and published events."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.catalog import duck as d
from corroborate.catalog.registry import query
from corroborate.catalog.views import now
from corroborate.functions.text import HINT_PATTERNS, REFUTATION_PATTERN, STOP_WORDS, collapse_spaces, entity_keys, tokens_of
from corroborate.functions.timefn import window_end
from corroborate.operators import clusters as C
from corroborate.operators import decisions as D
from corroborate.operators import editorial as X
from corroborate.operators import evidence as V
from corroborate.operators import shortlist as L
from corroborate.operators import similarity as S
from corroborate.plans import flows

ID_LIST = "array_to_string({}, ',')"

# --- proposals and pairs -----------------------------------------------------
_VERDICT = """
    SELECT batch_id, code, offending FROM (SELECT s.batch_id, CASE WHEN NOT s.shaped THEN 'current_window_proposal_invalid' WHEN f.code IS NOT NULL THEN f.code
               WHEN m.ids IS NOT NULL THEN 'current_window_missing_post_assignment' END AS code,
             CASE WHEN NOT s.shaped THEN '' WHEN f.code IS NOT NULL THEN f.post_id::VARCHAR ELSE coalesce(m.ids, '') END AS offending
      FROM (SELECT batch_id, bool_and(len(post_ids) BETWEEN 1 AND 40 AND confidence BETWEEN 0 AND 1) AS shaped FROM {table} GROUP BY 1) s
      LEFT JOIN (SELECT batch_id, arg_min(code, (cluster_no, pos)) AS code, arg_min(post_id, (cluster_no, pos)) AS post_id FROM (
          SELECT m.*, CASE WHEN b.post_id IS NULL THEN 'current_window_unknown_post_id'
                 WHEN row_number() OVER (PARTITION BY m.batch_id, m.post_id ORDER BY cluster_no, pos) > 1 THEN 'current_window_duplicate_post_assignment' END AS code
          FROM (SELECT batch_id, cluster_no, unnest(post_ids) AS post_id, unnest(range(len(post_ids))) AS pos FROM {table}) m
          LEFT JOIN batch_posts b ON b.batch_id = m.batch_id AND b.post_id = m.post_id) WHERE code IS NOT NULL GROUP BY batch_id) f USING (batch_id)
      LEFT JOIN (SELECT batch_id, string_agg(post_id::VARCHAR, ',' ORDER BY post_id) AS ids FROM batch_posts b
          WHERE NOT EXISTS (SELECT 1 FROM (SELECT batch_id, unnest(post_ids) AS post_id FROM {table}) m WHERE m.batch_id = b.batch_id AND m.post_id = b.post_id) GROUP BY 1) m USING (batch_id))"""
_RESOLVED = {
    "verdicts": _VERDICT.format(table="proposals"),
    "second_verdicts": _VERDICT.format(table="corrections"),
    "resolved": """
        SELECT batch_id, cluster_no, list_sort(post_ids) AS post_ids, classification, confidence, 'AI_CLUSTERING' AS processing_mode
        FROM proposals WHERE batch_id IN (SELECT batch_id FROM verdicts WHERE code IS NULL)
        UNION ALL SELECT batch_id, cluster_no, list_sort(post_ids), classification, confidence, 'AI_CLUSTERING' FROM corrections
        WHERE batch_id IN (SELECT batch_id FROM verdicts WHERE code IS NOT NULL) AND batch_id IN (SELECT batch_id FROM second_verdicts WHERE code IS NULL)
        UNION ALL SELECT batch_id, post_id, [post_id], 'UNCERTAIN', 0.0::DOUBLE, 'FAIL_CLOSED_SINGLETON_FALLBACK' FROM batch_posts
        WHERE batch_id IN (SELECT batch_id FROM verdicts WHERE code IS NOT NULL) AND batch_id IN (SELECT batch_id FROM second_verdicts WHERE code IS NOT NULL)""",
    "members": "SELECT batch_id, cluster_no, classification, unnest(post_ids) AS post_id FROM resolved",
    "pairs": """
        SELECT l.batch_id, l.cluster_no, l.post_id AS left_post_id, r.post_id AS right_post_id FROM members l JOIN members r
        ON l.batch_id = r.batch_id AND l.cluster_no = r.cluster_no AND l.post_id < r.post_id WHERE l.classification = 'EVENT'""",
    "judged": """
        SELECT p.*, j.confidence, coalesce(j.relationship = 'SAME_EVENT' AND j.confidence >= 0.95::DOUBLE, false) AS accepted
        FROM pairs p LEFT JOIN pair_judgments j USING (batch_id, left_post_id, right_post_id)""",
}


@query("validate_proposals", "I1", d.sql("SELECT batch_id, coalesce(code, 'ok') AS code, offending FROM verdicts", _RESOLVED))
def _(v):
    return C.validate_proposals(v.proposals, v.batch_posts).select(
        "batch_id", F.coalesce("code", F.lit("ok")).alias("code"), F.array_join(F.col("offending_post_ids").cast("array<string>"), ",").alias("offending")
    )


@query("resolve_proposals", "I2", d.sql(f"SELECT batch_id, {ID_LIST.format('post_ids')} AS post_ids, classification, confidence, processing_mode FROM resolved", _RESOLVED))
def _(v):
    return C.resolve_proposals(v.proposals, v.corrections, v.batch_posts).drop("cluster_no")


_ANSWERED = {
    **_RESOLVED,
    "answered": "SELECT * FROM proposals WHERE batch_id % 5 <> 2",
    "asked": "SELECT DISTINCT batch_id, batch_id % 10 <> 7 AS parsed FROM batch_posts",
    "answers": "SELECT a.batch_id, parsed, CASE WHEN v.batch_id IS NULL THEN 'current_window_proposal_invalid' ELSE v.code END AS code, coalesce(offending, '') AS offending FROM asked a LEFT JOIN answer_verdicts v USING (batch_id)",
    "answer_verdicts": _VERDICT.format(table="answered"),
}
_CLASSES = " ".join(f"WHEN {d.q(code)} THEN {d.q(name)}" for code, name in C.FAILURE_CLASSES.items())


def _answered(v):
    """Batches that were asked; one in five gave no clusters, half of these no readable answer."""
    asked = v.batch_posts.select("batch_id").distinct().withColumn("parsed", F.col("batch_id") % 10 != 7)
    return asked, v.proposals.filter("batch_id % 5 <> 2")


@query("validate_answers", "I1", d.sql(f"SELECT batch_id, coalesce(code, 'ok') AS code, offending, CASE WHEN NOT parsed THEN 'CURRENT_WINDOW_SCHEMA_FAILURE' ELSE coalesce(CASE code {_CLASSES} END, 'none') END AS failure_class FROM answers", _ANSWERED))
def _(v):
    asked, proposals = _answered(v)
    return C.validate_answers(asked, proposals, v.batch_posts).select(
        "batch_id",
        F.coalesce("code", F.lit("ok")).alias("code"),
        F.array_join(F.col("offending_post_ids").cast("array<string>"), ",").alias("offending"),
        F.coalesce("failure_class", F.lit("none")).alias("failure_class"),
    )


@query(
    "resolve_answers", "I2 I1",
    d.sql(f"""SELECT batch_id, {ID_LIST.format('list_sort(post_ids)')} AS post_ids, processing_mode FROM (
        SELECT batch_id, post_ids, 'AI_CLUSTERING' AS processing_mode FROM answered WHERE batch_id IN (SELECT batch_id FROM answers WHERE code IS NULL)
        UNION ALL SELECT batch_id, post_ids, 'AI_CLUSTERING' FROM corrections WHERE batch_id IN (SELECT batch_id FROM answers WHERE code IS NOT NULL) AND batch_id IN (SELECT batch_id FROM second_verdicts WHERE code IS NULL)
        UNION ALL SELECT batch_id, [post_id], 'FAIL_CLOSED_SINGLETON_FALLBACK' FROM batch_posts WHERE batch_id IN (SELECT batch_id FROM answers WHERE code IS NOT NULL) AND batch_id IN (SELECT batch_id FROM second_verdicts WHERE code IS NOT NULL))""", _ANSWERED),
)
def _(v):
    asked, proposals = _answered(v)
    return C.resolve_proposals(proposals, v.corrections, v.batch_posts, asked).select("batch_id", "post_ids", "processing_mode")


@query("proposed_pairs", "C8", d.sql("SELECT batch_id, left_post_id, right_post_id FROM pairs", _RESOLVED))
def _(v):
    return C.proposed_pairs(C.resolve_proposals(v.proposals, v.corrections, v.batch_posts)).drop("cluster_no")


@query("accepted_pairs", "B11", d.sql("SELECT batch_id, left_post_id, right_post_id, accepted FROM judged", _RESOLVED))
def _(v):
    clusters = C.resolve_proposals(v.proposals, v.corrections, v.batch_posts)
    return C.judge_pairs(C.proposed_pairs(clusters), v.pair_judgments).select("batch_id", "left_post_id", "right_post_id", "accepted")


def _placed_sql():
    from corroborate.catalog.text_queries import _PLACED

    up = "flatten(list_transform(places, lambda p: CASE p WHEN 'iran' THEN ['iran'] WHEN 'sadeghieh' THEN ['sadeghieh', 'tehran', 'iran'] ELSE [p, 'iran'] END))"
    return {
        **_RESOLVED,
        "placed": _PLACED,
        "raised": f"SELECT *, {up} AS up FROM placed",
        "vetted": """SELECT j.*, accepted AND len(a.places) > 0 AND len(b.places) > 0 AND NOT list_has_any(a.up, b.places) AND NOT list_has_any(a.places, b.up) AS vetoed
            FROM judged j JOIN raised a ON a.post_id = left_post_id JOIN raised b ON b.post_id = right_post_id""",
    }


@query("vetoed_pairs", "I3 H21", d.sql("SELECT batch_id, left_post_id, right_post_id, accepted, vetoed, accepted AND NOT vetoed AS usable FROM vetted", _placed_sql()))
def _(v):
    return flows.vetted_pairs(v.proposals, v.corrections, v.batch_posts, v.pair_judgments, v.posts)[1].select(
        "batch_id", "left_post_id", "right_post_id", "accepted", "vetoed", "usable"
    )


def _stars_sql():
    """One star of every cluster for each step, until nothing remains (at most 40 steps, one post each)."""
    touching = "list_filter(alive, lambda e: e.l = p OR e.r = p)"
    ranks = f"list_transform(remaining, lambda p: {{'d': -len({touching}), 'w': -coalesce(list_sum(list_transform({touching}, lambda e: e.c)), 0.0::DOUBLE), 'p': p}})"
    return {
        **_placed_sql(),
        "usable": "SELECT batch_id, cluster_no, list({'l': left_post_id, 'r': right_post_id, 'c': confidence} ORDER BY left_post_id, right_post_id) AS alive FROM vetted WHERE accepted AND NOT vetoed GROUP BY 1, 2",
        "paired": """SELECT r.batch_id, r.cluster_no, r.confidence, r.post_ids AS remaining, coalesce(u.alive, list_filter([{'l': 0::BIGINT, 'r': 0::BIGINT, 'c': 0.0::DOUBLE}], lambda e: false)) AS alive
            FROM resolved r LEFT JOIN usable u USING (batch_id, cluster_no) WHERE r.classification = 'EVENT' AND len(r.post_ids) >= 2""",
        "stars": f"""SELECT batch_id, cluster_no, confidence, remaining, alive, NULL::BIGINT AS anchor, alive AS mine, remaining AS members FROM paired UNION ALL
            SELECT batch_id, cluster_no, confidence, list_filter(remaining, lambda p: NOT list_contains(members, p)),
                list_filter(alive, lambda e: NOT list_contains(members, e.l) AND NOT list_contains(members, e.r)), anchor, mine, members
            FROM (SELECT *, list_sort(list_distinct(list_concat([anchor], list_concat(list_transform(mine, lambda e: e.l), list_transform(mine, lambda e: e.r))))) AS members
                  FROM (SELECT *, list_filter(alive, lambda e: e.l = anchor OR e.r = anchor) AS mine
                        FROM (SELECT batch_id, cluster_no, confidence, remaining, alive, list_sort({ranks})[1].p AS anchor FROM stars WHERE len(remaining) > 0)))""",
        "clustered": """SELECT batch_id, cluster_no, members AS post_ids, 'EVENT' AS classification, least(confidence, coalesce(list_min(list_transform(mine, lambda e: e.c)), confidence)) AS confidence,
                anchor AS anchor_post_id, len(mine) AS edge_count FROM stars WHERE anchor IS NOT NULL
            UNION ALL SELECT batch_id, cluster_no, [p], classification, confidence, p, 0
            FROM (SELECT *, unnest(post_ids) AS p FROM resolved WHERE NOT (classification = 'EVENT' AND len(post_ids) >= 2))""",
        "checked": """SELECT batch_id, count(*) AS pair_checks, count(*) FILTER (accepted) AS raw_same_event_edges, count(*) FILTER (accepted AND NOT vetoed) AS accepted_same_event_edges,
            count(*) FILTER (vetoed) AS hard_contradiction_vetoes, count(*) FILTER (NOT accepted OR vetoed) AS rejected_edges FROM vetted GROUP BY 1""",
    }


@query("star_clusters", "I4", d.sql(f"SELECT batch_id, cluster_no, {ID_LIST.format('post_ids')} AS post_ids, classification, confidence, anchor_post_id, edge_count FROM clustered", _stars_sql()))
def _(v):
    return flows.clusters(v.proposals, v.corrections, v.batch_posts, v.pair_judgments, v.posts)[0]


@query(
    "edge_stats", "D12",
    d.sql("""SELECT c.batch_id, c.multi AS final_multi_report_clusters, c.single AS final_singletons, coalesce(pair_checks, 0) AS pair_checks, coalesce(raw_same_event_edges, 0) AS raw_same_event_edges,
             coalesce(accepted_same_event_edges, 0) AS accepted_same_event_edges, coalesce(hard_contradiction_vetoes, 0) AS hard_contradiction_vetoes, coalesce(rejected_edges, 0) AS rejected_edges
             FROM (SELECT batch_id, count(*) FILTER (len(post_ids) > 1) AS multi, count(*) FILTER (len(post_ids) = 1) AS single FROM clustered GROUP BY 1) c LEFT JOIN checked k USING (batch_id)""", _stars_sql()),
)
def _(v):
    clusters, pairs = flows.clusters(v.proposals, v.corrections, v.batch_posts, v.pair_judgments, v.posts)
    return C.edge_stats(pairs, clusters)


@query(
    "pair_counters", "D12",
    d.sql("""SELECT batch_id, count(*) AS pair_checks, count(*) FILTER (accepted) AS raw_same_event_edges, count(*) FILTER (accepted AND NOT vetoed) AS accepted_same_event_edges,
             count(*) FILTER (vetoed) AS hard_contradiction_vetoes, count(*) FILTER (NOT accepted OR vetoed) AS rejected_edges FROM vetted GROUP BY 1""", _placed_sql()),
)
def _(v):
    clusters, pairs = flows.vetted_pairs(v.proposals, v.corrections, v.batch_posts, v.pair_judgments, v.posts)
    return C.edge_stats(pairs, clusters).drop("final_multi_report_clusters", "final_singletons").filter("pair_checks > 0")


def _decided():
    from corroborate.functions.text import CATEGORY_PATTERNS

    return d.sql(f"""SELECT batch_id, decision_no, {ID_LIST.format('post_ids')} AS post_ids, CASE WHEN classification IN ('NOISE', 'UNCERTAIN') THEN classification ELSE 'NEW_EVENT' END AS action,
        NULL::BIGINT AS event_id, NULL::BIGINT AS duplicate_of_post_id, confidence, left(t, 800) AS canonical_fact, {d.first_hit('t', CATEGORY_PATTERNS, "'IRAN'")} AS category,
        CASE WHEN classification = 'EVENT' THEN 'v8_current_window_anchor_cluster:' || anchor_post_id ELSE 'v8_current_window_' || lower(classification) END AS reason
        FROM (SELECT c.*, c.post_ids[1] AS decision_no, coalesce(nullif(p.normalized_text, ''), nullif(p.original_text, ''), 'Current-window report') AS t
              FROM clustered c LEFT JOIN posts p ON p.post_id = c.post_ids[1])""", _stars_sql())


@query("cluster_decisions", "I5", _decided())
def _(v):
    clusters, _ = flows.clusters(v.proposals, v.corrections, v.batch_posts, v.pair_judgments, v.posts)
    return C.decisions_from_clusters(clusters, v.posts)


# --- decisions ---------------------------------------------------------------
_KNOWN = "SELECT batch_id, (post_id - 1) // 4 + 1 AS event_id FROM batch_posts"
_CODES = {
    "known": _KNOWN,
    "hits": """
        SELECT batch_id, 0 AS stage, decision_no AS n, 0 AS pos, 'intelligence_output_invalid' AS code FROM decisions WHERE confidence > 1 OR len(list_distinct(post_ids)) <> len(post_ids)
        UNION ALL SELECT batch_id, 0, decision_no, 0, 'intelligence_invalid_duplicate_target' FROM decisions WHERE list_contains(post_ids, duplicate_of_post_id) AND confidence <= 1
        UNION ALL SELECT batch_id, 0, decision_no, 0, 'intelligence_action_reference_mismatch' FROM decisions WHERE (action IN ('MATCH_EXISTING_EVENT', 'UPDATE_EXISTING_EVENT')) <> (event_id IS NOT NULL)
        UNION ALL SELECT batch_id, 1, decision_no, -1, 'intelligence_unknown_event_id' FROM decisions x WHERE event_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM known k WHERE k.batch_id = x.batch_id AND k.event_id = x.event_id)
        UNION ALL SELECT batch_id, 1, decision_no, pos, 'intelligence_contradictory_post_assignment' FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, post_id ORDER BY decision_no, pos) AS k FROM decision_posts) WHERE k > 1
        UNION ALL SELECT batch_id, 1, decision_no, 41, 'intelligence_unknown_duplicate_target' FROM decisions x WHERE duplicate_of_post_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM batch_posts b WHERE b.batch_id = x.batch_id AND b.post_id = x.duplicate_of_post_id)
        UNION ALL SELECT batch_id, 3, 0, 0, 'intelligence_missing_post_assignment' FROM batch_posts b WHERE NOT EXISTS (SELECT 1 FROM decision_posts p WHERE p.batch_id = b.batch_id AND p.post_id = b.post_id)
        UNION ALL SELECT x.batch_id, 4, x.decision_no, 0, 'intelligence_invalid_duplicate_target' FROM decisions x JOIN decision_posts p ON p.batch_id = x.batch_id AND p.post_id = x.duplicate_of_post_id WHERE p.action IN ('NOISE', 'DUPLICATE', 'UNCERTAIN')""",
}


@query(
    "validate_decisions", "I6",
    d.sql("""SELECT batch_id, coalesce(code, 'ok') AS code, coalesce(code IN ('intelligence_contradictory_post_assignment', 'intelligence_missing_post_assignment',
             'intelligence_invalid_duplicate_target', 'intelligence_action_reference_mismatch'), false) AS recoverable
             FROM (SELECT DISTINCT batch_id FROM decisions) LEFT JOIN (SELECT batch_id, arg_min(code, (stage, n, pos)) AS code FROM hits GROUP BY 1) USING (batch_id)""", _CODES),
)
def _(v):
    known = v.batch_posts.select("batch_id", (F.floor((F.col("post_id") - 1) / 4) + 1).alias("event_id"))
    return D.validate_decisions(v.decisions, v.batch_posts, known).select(
        "batch_id", F.coalesce("code", F.lit("ok")).alias("code"), "recoverable"
    )


@query("ambiguous_posts", "I7", d.sql("SELECT DISTINCT batch_id, post_id FROM decision_posts WHERE action = 'UNCERTAIN' OR confidence < 0.72::DOUBLE"))
def _(v):
    return D.ambiguous_posts(v.decisions)


@query(
    "replace_ambiguous", "G2",
    d.sql("""SELECT batch_id, decision_no, action, array_to_string(post_ids, ',') AS post_ids FROM decisions x
             WHERE NOT EXISTS (SELECT 1 FROM decision_posts p JOIN decision_posts u ON u.batch_id = p.batch_id AND u.post_id = p.post_id AND (u.action = 'UNCERTAIN' OR u.confidence < 0.72::DOUBLE)
                               WHERE p.batch_id = x.batch_id AND p.decision_no = x.decision_no)
             UNION ALL SELECT DISTINCT batch_id, 1000 + post_id, 'NEW_EVENT', post_id::VARCHAR FROM decision_posts WHERE action = 'UNCERTAIN' OR confidence < 0.72::DOUBLE"""),
)
def _(v):
    unsure = D.ambiguous_posts(v.decisions)
    resolved = unsure.select(
        "batch_id",
        (F.col("post_id") + 1000).alias("decision_no"),
        F.array("post_id").alias("post_ids"),
        F.lit("NEW_EVENT").alias("action"),
        F.lit(None).cast("bigint").alias("event_id"),
        F.lit(None).cast("bigint").alias("duplicate_of_post_id"),
        F.lit(0.9).alias("confidence"),
        F.lit("fact").alias("canonical_fact"),
        F.lit("IRAN").alias("category"),
        F.lit("reason").alias("reason"),
    )
    return D.replace_ambiguous(v.decisions, resolved, unsure).select("batch_id", "decision_no", "action", "post_ids")


@query(
    "coverage_diff", "G3",
    d.sql("""SELECT batch_id, post_id, 'missing' AS side FROM batch_posts b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.batch_id = b.batch_id AND m.post_id = b.post_id)
             UNION ALL SELECT DISTINCT batch_id, post_id, 'unexpected' FROM m WHERE NOT EXISTS (SELECT 1 FROM batch_posts b WHERE b.batch_id = m.batch_id AND b.post_id = m.post_id)""",
          {"m": "SELECT batch_id, unnest(post_ids) AS post_id FROM proposals"}),
)
def _(v):
    return D.coverage_diff(v.batch_posts, v.proposals.select("batch_id", F.explode("post_ids").alias("post_id")))


_ACTIONS = {"actions": "SELECT batch_id, post_id, arg_max(action, decision_no) AS action, arg_max(coalesce(duplicate_of_post_id, -1), decision_no) AS target FROM decision_posts GROUP BY 1, 2"}


@query(
    "duplicate_graph", "I8 C11",
    d.sql("""SELECT e.batch_id, e.post_id, e.target AS target_post_id, coalesce(t.action, '') AS target_action,
             CASE WHEN b.post_id IS NULL OR t.action IS NULL THEN 'D_missing_target' WHEN e.target = e.post_id THEN 'E_cycle' WHEN t.action = 'NOISE' THEN 'B_duplicate_to_noise'
                  WHEN t.action = 'UNCERTAIN' THEN 'C_duplicate_to_uncertain' WHEN t.action = 'DUPLICATE' THEN 'A_duplicate_chain' ELSE 'F_other' END AS type
             FROM (SELECT batch_id, post_id, arg_max(duplicate_of_post_id, decision_no) AS target FROM decision_posts WHERE action = 'DUPLICATE' GROUP BY 1, 2) e
             LEFT JOIN actions t ON t.batch_id = e.batch_id AND t.post_id = e.target LEFT JOIN batch_posts b ON b.batch_id = e.batch_id AND b.post_id = e.target""", _ACTIONS),
)
def _(v):
    return D.duplicate_graph(v.decisions, v.batch_posts).withColumn("target_action", F.coalesce("target_action", F.lit("")))


_CHAINS = {
    **_ACTIONS,
    "walk": """SELECT batch_id, post_id, target AS tip, 1 AS depth FROM actions WHERE action = 'DUPLICATE'
               UNION ALL SELECT w.batch_id, w.post_id, a.target, depth + 1 FROM walk w JOIN actions a ON a.batch_id = w.batch_id AND a.post_id = w.tip AND a.action = 'DUPLICATE' WHERE depth < 64""",
}


@query(
    "resolve_duplicates", "I9",
    f"WITH RECURSIVE " + ", ".join(f"{n} AS ({s})" for n, s in {**{n: d.VIEWS[n] for n in ("raw_posts", "decisions", "decision_posts")}, **_CHAINS}.items()) + """,
        ends AS (SELECT w.batch_id, w.post_id, w.tip, coalesce(a.action IN ('NEW_EVENT', 'MATCH_EXISTING_EVENT', 'UPDATE_EXISTING_EVENT'), false) AS good
                 FROM (SELECT batch_id, post_id, arg_max(tip, depth) AS tip FROM walk GROUP BY 1, 2) w LEFT JOIN actions a ON a.batch_id = w.batch_id AND a.post_id = w.tip)
        SELECT e.batch_id, e.post_id, CASE WHEN safe THEN tip ELSE -1 END AS target_post_id, safe FROM ends e JOIN (SELECT batch_id, bool_and(good) AS safe FROM ends GROUP BY 1) USING (batch_id)""",
)
def _(v):
    return D.resolve_duplicates(v.decisions).withColumn("target_post_id", F.coalesce("target_post_id", F.lit(-1)))


_EVENT_IDS = {
    "attached": "SELECT doc_id + 1 AS post_id, doc_id // 5 + 1000000 AS event_id FROM labels",
    "targets": """SELECT x.batch_id, x.decision_no, x.action, x.post_ids, x.confidence, coalesce(a.event_id, o.event_id, x.post_ids[1]) AS target_event_id, a.event_id IS NULL AND o.event_id IS NULL AS created
        FROM decisions x LEFT JOIN (SELECT batch_id, decision_no, arg_min(t.event_id, pos) AS event_id FROM decision_posts p JOIN attached t USING (post_id) GROUP BY 1, 2) a USING (batch_id, decision_no)
        LEFT JOIN (SELECT event_id AS first, max(event_id + 5000000) AS event_id FROM stories GROUP BY 1) o ON o.first = x.post_ids[1] WHERE action NOT IN ('NOISE', 'DUPLICATE')""",
}


def _resolved(v):
    d_ = F.col("doc_id")
    attached = v.table("labels").select((d_ + 1).alias("post_id"), (F.floor(d_ / 5) + 1_000_000).alias("event_id"), F.lit(1).alias("seq"))
    origins = v.stories.select(F.col("event_id").alias("originating_post_id"), (F.col("event_id") + 5_000_000).alias("event_id"))
    return D.resolve_event_ids(v.decisions, attached, origins), attached


@query("resolve_event_ids", "I11", d.sql("SELECT batch_id, decision_no, target_event_id, created FROM targets", _EVENT_IDS))
def _(v):
    return _resolved(v)[0].select("batch_id", "decision_no", "target_event_id", "created")


@query(
    "created_events", "D25 I11",
    d.sql(f"""SELECT target_event_id AS event_id, post_ids[1] AS originating_post_id, {d.iso('published_at')} AS first_seen_at FROM targets JOIN raw_posts ON post_id = post_ids[1] WHERE created""", _EVENT_IDS),
)
def _(v):
    return D.events_from_decisions(_resolved(v)[0], v.posts, now()).select("event_id", "originating_post_id", "first_seen_at")


@query(
    "apply_decisions", "I12",
    d.sql("""SELECT p.batch_id, p.post_id, p.action, coalesce(CASE WHEN p.action = 'DUPLICATE' THEN coalesce(b.target_event_id, a.event_id) ELSE t.target_event_id END, -1) AS event_id
             FROM decision_posts p LEFT JOIN targets t USING (batch_id, decision_no)
             LEFT JOIN (SELECT batch_id, unnest(post_ids) AS post_id, target_event_id FROM targets) b ON b.batch_id = p.batch_id AND b.post_id = p.duplicate_of_post_id
             LEFT JOIN attached a ON a.post_id = p.duplicate_of_post_id""", _EVENT_IDS),
)
def _(v):
    resolved, attached = _resolved(v)
    copies = D.duplicate_events(v.decisions, resolved, attached)
    return D.batch_items(v.decisions, resolved, copies).select("batch_id", "post_id", "action", F.coalesce("event_id", F.lit(-1)).alias("event_id"))


@query(
    "duplicate_pairs", "I13",
    d.sql("SELECT post_id, duplicate_of_post_id, arg_min(confidence, (batch_id, confidence)) AS similarity_score, min(batch_id) AS batch_id FROM decision_posts WHERE action = 'DUPLICATE' GROUP BY 1, 2"),
)
def _(v):
    return D.duplicate_pairs(v.decisions)


@query(
    "apply_outcome", "D26",
    d.sql("""SELECT batch_id, count(*) FILTER (action = 'NEW_EVENT' AND created) AS new_events, count(*) FILTER (action IN ('MATCH_EXISTING_EVENT', 'UPDATE_EXISTING_EVENT')) AS existing_matches,
             count(*) FILTER (action = 'UNCERTAIN') AS uncertain, count(DISTINCT target_event_id) AS affected_events, any_value(coalesce(n, 0)) AS duplicates
             FROM targets LEFT JOIN (SELECT batch_id, count(*) AS n FROM (SELECT min(batch_id) AS batch_id FROM decision_posts WHERE action = 'DUPLICATE' GROUP BY post_id, duplicate_of_post_id) GROUP BY 1) USING (batch_id) GROUP BY 1""", _EVENT_IDS),
)
def _(v):
    return D.apply_outcome(_resolved(v)[0], D.duplicate_pairs(v.decisions))


# --- evidence ----------------------------------------------------------------
@query("attached_evidence", "C2", d.sql("SELECT event_id, post_id, source_id, name, priority_tier FROM evidence"))
def _(v):
    return V.attach_evidence(v.links, v.posts, v.sources).select("event_id", "post_id", "source_id", "name", "priority_tier")


def _evidence(v):
    """Evidence with the origin of every report; a copy has that of the report it copies."""
    return V.propagate_origins(*_copied(v, v.links))


def _copied(v, links):
    rows = V.attach_evidence(links, v.posts, v.sources)
    return rows, V.copied_from(rows)


@query("copied_reports", "C10 E7", d.sql("SELECT event_id, post_id, parent_post_id FROM links_copies"))
def _(v):
    return _copied(v, v.links)[1]


@query("copied_in_crowds", "C10 E7", d.sql("SELECT event_id, post_id, parent_post_id FROM crowded_links_copies"))
def _(v):
    return _copied(v, v.crowded_links)[1]


@query("copy_lineage", "I10 H38", d.sql("SELECT event_id, post_id, origin_group, origin_type, relationship_confidence FROM crowded_links_traced"))
def _(v):
    rows, copies = _copied(v, v.crowded_links)
    return V.propagate_origins(rows, copies).select("event_id", "post_id", "origin_group", "origin_type", "relationship_confidence")


@query(
    "copy_pairs", "C15",
    d.sql(f"""SELECT batch_id, left_post_id, right_post_id, ov AS overlap FROM (SELECT a.batch_id, a.post_id AS left_post_id, b.post_id AS right_post_id, {d.overlap('a.t', 'b.t')} AS ov
              FROM sets a JOIN sets b ON a.batch_id = b.batch_id AND a.post_id < b.post_id) WHERE ov >= 0.5::DOUBLE""", {"sets": f"SELECT p.doc_id // 32 AS batch_id, p.post_id, {d.words('normalized_text')} AS t FROM posts p"}),
)
def _(v):
    return V.copy_pairs(v.batch_posts, 0.5)


_SETS = {"sets": f"SELECT post_id, {d.words('normalized_text')} AS t FROM posts",
         "classed": "SELECT post_id, t, min(post_id) OVER (PARTITION BY list_sort(t)) AS class_id FROM sets WHERE len(t) > 0",
         "firsts": "SELECT class_id, t, posts FROM (SELECT *, count(*) OVER (PARTITION BY class_id) AS posts FROM classed) WHERE post_id = class_id"}


def _token_sets(v):
    return v.posts.select("post_id", tokens_of(F.col("normalized_text")).alias("tokens"))


@query("copy_classes", "C15", d.sql("SELECT post_id, class_id FROM classed", _SETS))
def _(v):
    return S.set_classes(_token_sets(v)).select("post_id", "class_id")


@query(
    "copy_links", "C15",
    d.sql(f"""SELECT left_id, right_id, left_posts, right_posts, ov AS overlap FROM (
              SELECT a.class_id AS left_id, b.class_id AS right_id, a.posts AS left_posts, b.posts AS right_posts, {d.overlap('a.t', 'b.t')} AS ov
              FROM firsts a JOIN firsts b ON a.class_id < b.class_id AND len(a.t) >= 0.85 * len(b.t) AND len(b.t) >= 0.85 * len(a.t)) WHERE ov >= 0.86::DOUBLE""", _SETS),
)
def _(v):
    return S.copy_links(_token_sets(v))


_DENIES = d.has("text", REFUTATION_PATTERN)
_GROUPS = {
    "grouped": f"""SELECT event_id, origin_group, bool_or((trust_score >= 0.55::DOUBLE OR priority_tier = 'TIER_1') AND (origin_type <> 'aggregation' OR priority_tier = 'TIER_1')) AS credible,
        bool_and(NOT {_DENIES}) AS supports, count(DISTINCT source_id) AS sources, count(*) AS evidence_rows FROM evidence GROUP BY 1, 2""",
    "verified": """SELECT event_id, n AS independent_confirmation_count, source_count, origin_groups,
        CASE WHEN denied AND n > 0 THEN 'DISPUTED' WHEN n >= 2 THEN 'CONFIRMED' WHEN n = 1 THEN 'DEVELOPING' ELSE 'UNVERIFIED' END AS verification_status
        FROM (SELECT event_id, count(*) FILTER (credible AND supports) AS n, bool_or(NOT supports) AS denied, CAST(sum(evidence_rows) AS BIGINT) AS source_count, count(*) AS origin_groups FROM grouped GROUP BY 1)""",
}


@query("origin_groups", "D1 H18", d.sql("SELECT * FROM grouped", _GROUPS))
def _(v):
    return V.origin_groups(_evidence(v))


@query("verify_events", "D2", d.sql("SELECT * FROM verified", _GROUPS))
def _(v):
    return V.verify_events(V.origin_groups(_evidence(v)))


@query("distinct_sources", "D2", d.sql("SELECT event_id, count(DISTINCT source_id) AS distinct_sources FROM evidence GROUP BY 1"))
def _(v):
    return V.distinct_sources(V.attach_evidence(v.links, v.posts, v.sources))


@query("first_tier_events", "D6", d.sql("SELECT event_id, bool_or(priority_tier = 'TIER_1') AS high_priority FROM evidence GROUP BY 1"))
def _(v):
    return V.first_tier_events(V.attach_evidence(v.links, v.posts, v.sources))


def _category(expr):
    from corroborate.functions.text import CATEGORY_PATTERNS

    return d.first_hit(expr, CATEGORY_PATTERNS, "'IRAN'")


_FACTS = {"facts": f"""SELECT event_id, left(t, 800) AS core_fact, {_category('t')} AS category, first_seen_at, last_updated_at FROM (
    SELECT event_id, arg_min(text, post_id) AS t, arg_min(attached_at, post_id) AS first_seen_at, max(attached_at) AS last_updated_at FROM evidence GROUP BY 1)"""}


@query("event_facts", "D25", d.sql(f"SELECT event_id, core_fact, category, {d.iso('first_seen_at')} AS first_seen_at, {d.iso('last_updated_at')} AS last_updated_at FROM facts", _FACTS))
def _(v):
    return V.event_facts(V.attach_evidence(v.links, v.posts, v.sources))


def _score_sql(table: str) -> str:
    n = "independent_confirmation_count"
    hours = f"greatest(0.0::DOUBLE, (epoch_us({d.NOW}) - epoch_us(first_seen_at))::DOUBLE / 3600000000.0::DOUBLE)"
    cl = lambda x: f"least(100, greatest(0, CAST(floor(({x})::DOUBLE + 0.5::DOUBLE) AS BIGINT)))"
    return f"""SELECT *, CAST(floor(impact::DOUBLE * 0.25::DOUBLE + iran_relevance::DOUBLE * 0.25::DOUBLE + urgency::DOUBLE * 0.15::DOUBLE + confidence::DOUBLE * 0.15::DOUBLE
          + novelty::DOUBLE * 0.1::DOUBLE + geopolitical::DOUBLE * 0.1::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS importance_score
        FROM (SELECT *, {cl(f"20 + least({n}, 3) * 8 + CASE category WHEN 'WAR_SECURITY' THEN 25 WHEN 'POLITICS' THEN 18 WHEN 'ECONOMY' THEN 18 WHEN 'SOCIETY' THEN 18 WHEN 'WORLD' THEN 15 WHEN 'TECHNOLOGY' THEN 12 ELSE 10 END")} AS impact,
          CASE category WHEN 'IRAN' THEN 92 WHEN 'POLITICS' THEN 82 WHEN 'WAR_SECURITY' THEN 82 WHEN 'ECONOMY' THEN 72 WHEN 'SOCIETY' THEN 72 WHEN 'TECHNOLOGY' THEN 48 WHEN 'WORLD' THEN 42 ELSE 45 END AS iran_relevance,
          {cl("95.0::DOUBLE - hours * 9.0::DOUBLE + CASE WHEN event_state = 'active' THEN 5 ELSE 0 END")} AS urgency,
          CASE verification_status WHEN 'CONFIRMED' THEN {cl(f"72 + {n} * 7")} WHEN 'DEVELOPING' THEN {cl(f"42 + {n} * 9")} WHEN 'DISPUTED' THEN 24 ELSE 8 END AS confidence,
          CASE WHEN hours <= 2 THEN 82 WHEN hours <= 6 THEN 68 WHEN hours <= 24 THEN 48 ELSE 25 END AS novelty,
          CASE category WHEN 'WAR_SECURITY' THEN 72 WHEN 'POLITICS' THEN 55 WHEN 'WORLD' THEN 55 WHEN 'ECONOMY' THEN 38 WHEN 'SOCIETY' THEN 28 WHEN 'TECHNOLOGY' THEN 24 ELSE 22 END AS geopolitical
        FROM (SELECT *, {hours} AS hours FROM {table}))"""


def _band(x: str) -> str:
    return f"CASE WHEN {x} >= 90 THEN 'BREAKING' WHEN {x} >= 78 THEN 'CANDIDATE' WHEN {x} >= 60 THEN 'MONITOR' ELSE 'IGNORE' END"


_CONFIRMED = d.sql(
    f"""SELECT event_id, verification_status, independent_confirmation_count, source_count, category, importance_score, {_band('importance_score')} AS band FROM scored""",
    {**_GROUPS, **_FACTS, "joined": "SELECT f.*, v.* EXCLUDE (event_id), 'active' AS event_state FROM facts f JOIN verified v USING (event_id)", "scored": _score_sql("joined")},
)


@query("confirmed_events", "D1 D2 H36 F2 I10", _CONFIRMED)
def _(v):
    """Flagship: every event with its verification and score, best first; a copied report confirms nothing."""
    return flows.confirmed_events(v.links, v.posts, v.sources, now())


@query("confirmed_with_copies", "I10 D1 D2 H36", _CONFIRMED)
def _(v):
    """The flagship from its parts: evidence, copies, origins, verification."""
    from corroborate.operators.evidence import event_facts

    rows, copies = _copied(v, v.links)
    verified = V.verify_events(V.origin_groups(V.propagate_origins(rows, copies)))
    events = event_facts(rows).join(verified, "event_id").withColumn("event_state", F.lit("active"))
    return X.score_events(events, now()).select(
        "event_id", "verification_status", "independent_confirmation_count", "source_count", "category", "importance_score", "band"
    )


def _entity_hits(expr):
    from corroborate.functions.text import ENTITY_PATTERNS

    return d.all_hits(expr, ENTITY_PATTERNS)


_ENTITIES = {"entities": f"SELECT DISTINCT event_id, unnest({_entity_hits('text')}) AS entity_key FROM evidence"}


@query("event_entities", "I14 H6", d.sql("SELECT * FROM entities", _ENTITIES))
def _(v):
    return V.event_entities(V.attach_evidence(v.links, v.posts, v.sources))


@query("event_tags", "F8", d.sql("SELECT event_id, string_agg(entity_key, ',' ORDER BY entity_key) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY entity_key) AS n FROM entities) WHERE n <= 8 GROUP BY 1", _ENTITIES))
def _(v):
    return V.event_tags(V.event_entities(V.attach_evidence(v.links, v.posts, v.sources)))


@query(
    "event_versions", "E11",
    d.sql("SELECT event_id, post_id, 1 + CAST(sum(CASE WHEN post_id % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_id ORDER BY attached_at, post_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event_version FROM crowded_links"),
)
def _(v):
    rows = v.crowded_links.withColumn("bumping", F.col("post_id") % 3 != 0)
    twice = rows.unionByName(rows)
    return V.event_versions(twice).select("event_id", "post_id", "event_version")


@query("top_evidence", "F4", d.sql("SELECT event_id, post_id, n AS evidence_rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY priority_tier, trust_score DESC, post_id) AS n FROM evidence) WHERE n <= 6"))
def _(v):
    return V.top_evidence(V.attach_evidence(v.links, v.posts, v.sources), 6).select("event_id", "post_id", "evidence_rank")


@query(
    "post_history", "C3 D7",
    d.sql("""SELECT p.post_id, coalesce(e.ids, '') AS event_ids, coalesce(e.groups, '') AS origin_groups FROM raw_posts p LEFT JOIN (SELECT post_id, string_agg(DISTINCT event_id::VARCHAR, ',' ORDER BY event_id::VARCHAR) AS ids,
             string_agg(DISTINCT origin_group, ',' ORDER BY origin_group) AS groups FROM evidence GROUP BY 1) e USING (post_id)"""),
)
def _(v):
    return V.post_history(v.raw_posts, _evidence(v).select("event_id", "post_id", "origin_group")).select("post_id", "event_ids", "origin_groups")


# --- shortlist ---------------------------------------------------------------
_WINDOWS = {"windows": "SELECT DISTINCT time_bucket(INTERVAL 5 MINUTE, ts) AS w FROM log"}


def _windows(v):
    return v.log.select(window_end(F.col("ts")).alias("window_end")).distinct()


@query(
    "eligible_event_counts", "C9",
    d.sql(f"""SELECT {d.iso('w')} AS window_end, CAST((SELECT count(*) FROM event_rows e WHERE e.first_seen_at <= w AND e.last_updated_at >= w - INTERVAL 48 HOUR) AS BIGINT) AS active_events FROM windows""", _WINDOWS),
)
def _(v):
    return L.eligible_event_counts(_windows(v), v.events)


@query(
    "newest_events", "F5 C9",
    d.sql(f"""SELECT {d.iso('w')} AS window_end, event_id, n AS event_rank FROM (SELECT w, event_id, row_number() OVER (PARTITION BY w ORDER BY last_updated_at DESC, event_id DESC) AS n
              FROM windows JOIN event_rows e ON e.first_seen_at <= w AND e.last_updated_at >= w - INTERVAL 48 HOUR) WHERE n <= 40""", _WINDOWS),
)
def _(v):
    return L.newest_events(_windows(v), v.events).select("window_end", "event_id", "event_rank")


_KEPT_WORDS = ", ".join(d.q(w) for w in STOP_WORDS)
_VOCABULARY = "list_filter({}, lambda w: w NOT IN (" + _KEPT_WORDS + "))"
_SCORED_REACH = {
    "reports": "SELECT time_bucket(INTERVAL 5 MINUTE, observed_at) + INTERVAL 5 MINUTE AS w, original_text AS text FROM raw_posts",
    "report_words": f"SELECT DISTINCT w, unnest({_VOCABULARY.format(d.words('text', 3))}) AS t FROM reports",
    "hinted": f"SELECT DISTINCT w, unnest({d.all_hits('text', HINT_PATTERNS)}) AS category FROM reports",
    "about": f"""SELECT event_id, category, first_seen_at, last_updated_at, {_VOCABULARY.format(d.words("(left(core_fact, 800) || ' Channel ' || event_id % 9)", 3))} AS t FROM event_rows""",
    "event_words": "SELECT event_id, unnest(t) AS t FROM about",
    "meetings": "SELECT w, event_id, count(*) AS shared FROM report_words JOIN event_words USING (t) GROUP BY 1, 2",
    "rated": """SELECT w, event_id, last_updated_at, coalesce(shared, 0) AS shared, coalesce(shared, 0) * 10 + CASE WHEN h.category IS NULL THEN 0 ELSE 4 END
            + 1.0::DOUBLE / (1.0::DOUBLE + greatest(0.0::DOUBLE, (epoch_us(w) - epoch_us(last_updated_at)) / 3600000000.0::DOUBLE) / 24.0::DOUBLE) AS score
        FROM (SELECT DISTINCT w FROM reports) JOIN about a ON first_seen_at <= w AND last_updated_at >= w - INTERVAL 48 HOUR
        LEFT JOIN meetings USING (w, event_id) LEFT JOIN hinted h USING (w, category)""",
}


@query(
    "scored_events", "F5",
    d.sql(f"""SELECT {d.iso('w')} AS window_end, event_id, shared, n AS event_rank FROM (
              SELECT *, row_number() OVER (PARTITION BY w ORDER BY score DESC, last_updated_at DESC, event_id DESC) AS n FROM rated) WHERE n <= 10""", _SCORED_REACH),
)
def _(v):
    end = F.timestamp_micros(F.unix_micros(window_end(F.col("observed_at"))) + 300_000_000)
    reports = v.raw_posts.select(end.alias("window_end"), F.col("original_text").alias("text"))
    text = F.concat(F.substring("core_fact", 1, 800), F.lit(" Channel "), F.col("event_id") % 9)
    events = v.events.select("event_id", text.alias("text"), "category", "first_seen_at", "last_updated_at")
    return L.scored_events(reports, events, 10).select("window_end", "event_id", "shared", "event_rank")


# --- editorial ---------------------------------------------------------------
_SCORED = {"scored": _score_sql("event_rows")}
_GATED = {
    **_SCORED,
    "gated": """SELECT *, CASE WHEN used THEN rec WHEN importance_score >= 60 THEN 'MONITOR' ELSE 'IGNORE' END AS recommendation,
        CASE WHEN used THEN least(100, greatest(0, importance_score + adjustment)) ELSE importance_score END AS effective_score,
        CASE WHEN used THEN brk ELSE importance_score >= 90 END AS breaking_candidate
        FROM (SELECT s.*, j.recommendation AS rec, j.adjustment, j.breaking AS brk, coalesce(importance_score >= 75 AND j.adjustment BETWEEN -20 AND 20, false) AS used
              FROM scored s LEFT JOIN judgments j USING (event_id, event_version))""",
}


@query("score_events", "H36", d.sql(f"SELECT event_id, impact, iran_relevance, urgency, confidence, novelty, geopolitical, importance_score, {_band('importance_score')} AS band FROM scored", _SCORED))
def _(v):
    return X.score_events(v.events, now()).select(
        "event_id", "impact", "iran_relevance", "urgency", "confidence", "novelty", "geopolitical", "importance_score", "band"
    )


def _gated(v):
    return X.editorial_gate(X.score_events(v.events, now()), v.judgments)


@query("editorial_gate", "B12 H37", d.sql(f"SELECT event_id, used AS used_judgment, recommendation, effective_score, breaking_candidate, {_band('effective_score')} AS effective_band FROM gated", _GATED))
def _(v):
    return _gated(v).select("event_id", "used_judgment", "recommendation", "effective_score", "breaking_candidate", "effective_band")


_PUBLISHED = {"published": "SELECT event_id, min(story_id) AS story_id FROM stories WHERE publication_state = 'published' GROUP BY 1"}
_CANDIDATES = {
    **_GATED,
    **_PUBLISHED,
    "compared": """SELECT g.*, s.publish_key IS NOT NULL AS has_story,
        (NOT used OR recommendation = 'PUBLISH' OR (recommendation = 'MONITOR' AND breaking_candidate AND effective_score >= 90)) AS allowed,
        CASE WHEN g.verification_status = 'UNVERIFIED' THEN false WHEN g.verification_status = 'DEVELOPING' AND NOT (effective_score >= 90 AND high_priority) THEN false
             WHEN g.verification_status = 'DISPUTED' AND effective_score < 90 THEN false ELSE effective_score >= 78 END AS gate,
        coalesce(s.message_id IS NOT NULL AND g.event_version > s.event_version AND (g.verification_status <> s.verification_status
             OR (g.verification_status = 'CONFIRMED' AND independent_confirmation_count >= s.independent_confirmations + 2)
             OR (effective_score >= 90 AND independent_confirmation_count > s.independent_confirmations)), false) AS edits
        FROM gated g LEFT JOIN (SELECT t.* FROM stories t JOIN published p USING (event_id, story_id)) s USING (event_id)""",
}


@query(
    "editorial_candidates", "B13 B14 B15 B16",
    d.sql("""SELECT event_id, NOT has_story AND allowed AND gate AS publish, has_story AND edits AS material_update,
        CASE WHEN NOT has_story AND allowed AND gate THEN 'PUBLISH' WHEN effective_score >= 60 THEN 'MONITOR' ELSE 'IGNORE' END AS decision,
        CASE WHEN has_story AND edits THEN 'update_queued' WHEN NOT has_story AND allowed AND gate THEN 'queued' ELSE 'pending' END AS status FROM compared""", _CANDIDATES),
)
def _(v):
    gated = _gated(v)
    tiers = v.events.select("event_id", "high_priority")
    return X.candidate_rows(gated.drop("high_priority"), tiers, v.stories, F.lit(0)).select("event_id", "publish", "material_update", "decision", "status")


def _script(column, letters):
    return f"length(regexp_replace({column}, '[^{letters}]', '', 'g'))"


_PERSIAN = " AND ".join(f"{_script(c, '؀-ۿ')} >= 5 AND {_script(c, '؀-ۿ')} >= {_script(c, 'A-Za-z')}" for c in ("title", "description"))
_DRAFTS = {
    "drafts": f"""SELECT *, {_PERSIAN} AS persian FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN left({d.flat('core_fact')}, 100) ELSE 'بازار ایران ' || event_id END AS title,
        CASE WHEN event_id % 5 = 0 THEN left(core_fact, 300) ELSE 'گزارش تازه از تهران ' || event_id END AS description FROM event_rows)""",
}


@query(
    "blocked_candidates", "B15 B19",
    d.sql("""SELECT event_id, CASE WHEN has_story AND edits THEN CASE WHEN persian THEN 'update_queued' ELSE 'update_story_blocked' END
             WHEN NOT has_story AND allowed AND gate THEN CASE WHEN persian THEN 'queued' ELSE 'story_blocked' END ELSE 'pending' END AS status FROM compared JOIN drafts USING (event_id)""", {**_CANDIDATES, **_DRAFTS}),
)
def _(v):
    fact, number = F.col("core_fact"), F.col("event_id").cast("string")
    drafts = v.events.select(
        "event_id", "event_version",
        F.when(F.col("event_id") % 3 == 0, F.substring(collapse_spaces(fact), 1, 100)).otherwise(F.concat(F.lit("بازار ایران "), number)).alias("title"),
        F.when(F.col("event_id") % 5 == 0, F.substring(fact, 1, 300)).otherwise(F.concat(F.lit("گزارش تازه از تهران "), number)).alias("description"),
    )
    tiers = v.events.select("event_id", "high_priority")
    candidates = X.candidate_rows(_gated(v).drop("high_priority"), tiers, v.stories, F.lit(0))
    return X.block_stories(candidates, drafts).select("event_id", "status")


@query(
    "daily_budget", "E6",
    d.sql("""SELECT event_id, eligible_rank, eligible AND (score >= 90 OR eligible_rank <= 15) AS admitted FROM (SELECT *, CAST(sum(CASE WHEN eligible THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS eligible_rank
             FROM (SELECT *, decision = 'PUBLISH' AND score >= 78 AS eligible FROM candidates))"""),
)
def _(v):
    from corroborate.operators.blocks import time_block

    rows = v.candidates.withColumn("eligible", (F.col("decision") == "PUBLISH") & (F.col("score") >= 78))
    return X.daily_budget(rows, "day", ["created_at", "event_id"], time_block(F.col("created_at"))).select("event_id", "eligible_rank", "admitted")


_CHANGES = {
    "versions": "SELECT (event_id - 1) // 5 AS e, event_id AS version, core_fact AS fact, verification_status AS status, importance_score AS score FROM scored",
    "stepped": """SELECT *, lag(fact) OVER w AS f0, lag(status) OVER w AS s0, lag(score) OVER w AS p0 FROM versions WINDOW w AS (PARTITION BY e ORDER BY version)""",
}


@query(
    "version_changes", "B17 B18 E10",
    d.sql("""SELECT version, CASE WHEN f0 IS NULL THEN 'first' WHEN f0 = fact AND s0 = status AND p0 = score THEN 'NO_CHANGE' WHEN s0 <> status AND (status = 'DISPUTED' OR s0 = 'CONFIRMED') THEN 'CONTRADICTION'
             WHEN f0 <> fact AND p0 - score >= 15 THEN 'CORRECTION' WHEN abs(p0 - score) >= 15 OR f0 <> fact THEN 'MAJOR_UPDATE' ELSE 'MINOR_UPDATE' END AS update_type,
             CASE WHEN f0 IS NULL THEN 'first' WHEN s0 = 'CONFIRMED' AND status = 'DISPUTED' THEN 'CONTRADICTION' WHEN s0 <> status THEN 'MAJOR_UPDATE' ELSE 'MINOR_UPDATE' END AS published_update_type FROM stepped""",
          {**_SCORED, **_CHANGES}),
)
def _(v):
    return X.version_changes(_versions(v), 8).select(
        F.col("event_version").alias("version"),
        F.coalesce("update_type", F.lit("first")).alias("update_type"),
        F.coalesce("published_update_type", F.lit("first")).alias("published_update_type"),
    )


def _versions(v):
    """Five consecutive documents read as the versions of one event."""
    return X.score_events(v.events, now()).select(
        F.floor((F.col("event_id") - 1) / 5).alias("event_id"),
        F.col("event_id").alias("event_version"),
        "core_fact",
        "verification_status",
        "importance_score",
    )


@query(
    "update_snapshots", "H43",
    d.sql("""SELECT version, p0 AS old_score, score AS new_score, s0 AS old_status FROM stepped WHERE f0 IS NOT NULL AND NOT (f0 = fact AND s0 = status AND p0 = score)""", {**_SCORED, **_CHANGES}),
)
def _(v):
    shots = X.update_snapshots(X.version_changes(_versions(v), 8))
    return shots.select(
        F.col("event_version").alias("version"),
        F.get_json_object("previous_snapshot", "$.importance_score").cast("bigint").alias("old_score"),
        F.get_json_object("new_snapshot", "$.importance_score").cast("bigint").alias("new_score"),
        F.get_json_object("previous_snapshot", "$.verification_status").alias("old_status"),
    )


@query(
    "claim_publication", "E8",
    d.sql("""SELECT j.publish_key, CASE WHEN j.publish_key = w.k AND coalesce(p.lo = j.publish_key AND p.hi = j.publish_key, true) THEN 'processing' ELSE 'suppressed_duplicate' END AS status
             FROM stories j JOIN (SELECT event_id, arg_min(publish_key, (created_at, publish_key)) AS k FROM stories GROUP BY 1) w USING (event_id)
             LEFT JOIN (SELECT event_id, min(publish_key) AS lo, max(publish_key) AS hi FROM stories WHERE publication_state = 'published' GROUP BY 1) p USING (event_id)"""),
)
def _(v):
    return X.claim_publication(v.stories.select("event_id", "publish_key", "created_at"), v.stories).select("publish_key", "status")


@query(
    "pending_publications", "C4 F6",
    d.sql("""SELECT c.event_id, c.event_version, importance_score, coalesce(s.publish_key, '') AS pending_publish_key, coalesce(p.publish_key, '') AS published_publish_key
             FROM candidates c JOIN scored e ON e.event_id = c.event_id LEFT JOIN stories s ON s.event_id = c.event_id AND s.event_version = c.event_version
             LEFT JOIN stories p ON p.event_id = c.event_id AND p.publication_state = 'published'
             WHERE c.decision = 'PUBLISH' AND c.status IN ('pending', 'failed', 'update_pending', 'update_failed') AND (s.story_id IS NULL OR s.publication_state IN ('pending', 'failed'))
             AND (p.story_id IS NULL OR p.event_version < c.event_version)
             ORDER BY importance_score DESC, c.event_id, c.event_version LIMIT 2""", _SCORED),
)
def _(v):
    scored = X.score_events(v.events, now())
    return X.pending_publications(v.candidates, scored, v.stories).select(
        "event_id", "event_version", "importance_score",
        F.coalesce("pending_publish_key", F.lit("")).alias("pending_publish_key"),
        F.coalesce("published_publish_key", F.lit("")).alias("published_publish_key"),
    )


@query(
    "stale_publications", "C5 F7",
    d.sql(f"""SELECT s.publish_key, {d.iso('s.updated_at')} AS updated_at FROM stories s JOIN candidates c ON c.event_id = s.event_id AND c.event_version = s.event_version
              WHERE c.decision = 'PUBLISH' AND s.publication_state IN ('pending', 'failed', 'processing') AND s.updated_at < {d.NOW} - INTERVAL 10 MINUTE ORDER BY s.updated_at, s.publish_key LIMIT 2"""),
)
def _(v):
    return X.stale_publications(v.stories, v.candidates, now()).select("publish_key", "updated_at")


@query(
    "oldest_stale", "F7",
    d.sql(f"""SELECT post_id FROM posts WHERE processing_status = 'analyzing' AND (analysis_lease_at IS NULL OR analysis_lease_at < {d.NOW} - INTERVAL 10 MINUTE)
              ORDER BY coalesce(analysis_lease_at, created_at), post_id LIMIT 1"""),
)
def _(v):
    rows = v.posts.withColumn("status", F.col("processing_status"))
    return X.oldest_stale(rows, "analyzing", "analysis_lease_at", "created_at", now(), "post_id").select("post_id")


@query(
    "events_with_candidates", "C14",
    d.sql("""SELECT e.event_id, coalesce(c.decision, '') AS decision, coalesce(c.status, '') AS candidate_status, coalesce(c.score, -1) AS editorial_score
             FROM event_rows e LEFT JOIN candidates c ON c.event_id = e.event_id AND c.event_version = e.event_version"""),
)
def _(v):
    return X.events_with_candidates(v.events, v.candidates).select(
        "event_id", F.coalesce("decision", F.lit("")).alias("decision"), F.coalesce("candidate_status", F.lit("")).alias("candidate_status"),
        F.coalesce("editorial_score", F.lit(-1)).alias("editorial_score"),
    )


@query("draft_stories", "F4 F8 H26 H27 B19")
def _(v):
    rows = V.attach_evidence(v.links, v.posts, v.sources).join(v.posts.select("post_id", "canonical_url"), "post_id")
    tags = V.event_tags(V.event_entities(rows))
    facts = V.event_facts(rows).join(V.verify_events(V.origin_groups(_evidence(v))), "event_id")
    return X.draft_stories(facts, rows, tags).select("event_id", "title", "description", "tags", F.size("links").alias("links"), F.size("primary_sources").alias("primary"), "publishable")
