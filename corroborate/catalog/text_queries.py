"""Registered queries over texts, places, origins, times and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corroborate.catalog import duck as d
from corroborate.catalog.registry import QUERIES, query
from corroborate.catalog.views import now
from corroborate.functions import caption, html, jsonfn, origin, places, scoring, text, timefn
from corroborate.operators import gazetteer
from corroborate.operators.blocks import previous_value, time_block

JOINED = "array_to_string({}, ',')"


@query("normalize_text", "H1", d.sql("SELECT post_id, sha256(normalized_text) AS text_hash, length(normalized_text) AS chars FROM posts"))
def _(v):
    t = text.normalize_text(F.col("original_text"))
    return v.raw_posts.withColumn("t", t).select(
        "post_id", F.sha2("t", 256).alias("text_hash"), F.char_length("t").alias("chars")
    )


@query("noise_reasons", "H2", d.sql("SELECT coalesce(noise_reason, 'clean') AS reason, count(*) AS posts FROM posts GROUP BY 1"))
def _(v):
    reason = text.noise_reason(text.normalize_text(F.col("original_text")))
    return v.raw_posts.groupBy(F.coalesce(reason, F.lit("clean")).alias("reason")).agg(F.count("*").alias("posts"))


@query("token_sets", "H3", d.sql(f"SELECT post_id, len(t) AS tokens, sha256(array_to_string(list_sort(t), ' ')) AS token_hash FROM (SELECT post_id, {d.words('normalized_text')} AS t FROM posts)"))
def _(v):
    rows = v.raw_posts.withColumn("t", text.tokens(F.col("original_text")))
    return rows.select(
        "post_id", F.size("t").alias("tokens"), F.sha2(F.array_join(F.array_sort("t"), " "), 256).alias("token_hash")
    )


_NEIGHBOURS = f"""
    SELECT post_id, published_at, original_text, {d.words('normalized_text')} AS t,
           lag(published_at) OVER w AS before_at, lag({d.words('normalized_text')}) OVER w AS before_t,
           lag(original_text) OVER w AS before_text
    FROM posts WINDOW w AS (PARTITION BY source_id ORDER BY published_at, post_id)"""
_PROX = "greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(epoch_us(published_at) - epoch_us(before_at))::DOUBLE / (48.0::DOUBLE * 3600000000))"


def neighbours(v):
    """Every post with the post before it on its channel."""
    rows = v.raw_posts.select("post_id", "source_id", "published_at", "original_text")
    value = F.struct(F.col("published_at").alias("at"), F.col("original_text").alias("text"))
    return previous_value(
        rows, ["source_id"], ["published_at", "post_id"], time_block(F.col("published_at")), value, "before"
    ).filter("before is not null")


@query(
    "token_overlap", "H4 H5 H31",
    d.sql(f"""
        SELECT post_id, ov AS overlap, {_PROX} AS proximity,
               least(1.0::DOUBLE, (CASE WHEN len(t) > 0 AND len(t) = len(before_t) AND ov = 1 THEN 1 ELSE 0 END) * 0.2::DOUBLE
                     + ov * 0.7::DOUBLE + {_PROX} * 0.1::DOUBLE) AS copy_score
        FROM (SELECT *, {d.overlap('t', 'before_t')} AS ov FROM neighbours WHERE before_at IS NOT NULL)""", {"neighbours": _NEIGHBOURS}),
)
def _(v):
    rows = neighbours(v).select(
        "post_id",
        text.tokens(F.col("original_text")).alias("a"),
        text.tokens(F.col("before.text")).alias("b"),
        timefn.time_proximity(F.col("published_at"), F.col("before.at")).alias("proximity"),
    )
    return rows.select(
        "post_id",
        text.set_overlap(F.col("a"), F.col("b")).alias("overlap"),
        "proximity",
        text.copy_score(F.col("a"), F.col("b"), F.col("proximity")).alias("copy_score"),
    )


@query("entity_keys", "H6", d.sql(f"SELECT post_id, array_to_string({d.all_hits('original_text', text.ENTITY_PATTERNS)}, ',') AS entities FROM raw_posts"))
def _(v):
    return v.raw_posts.select("post_id", text.entity_keys(F.col("original_text")).alias("entities"))


@query(
    "entity_overlap", "H7",
    d.sql(f"""SELECT post_id, {d.overlap('a', 'b')} AS overlap FROM
        (SELECT post_id, {d.all_hits('original_text', text.ENTITY_PATTERNS)} AS a, {d.all_hits('before_text', text.ENTITY_PATTERNS)} AS b
         FROM neighbours WHERE before_at IS NOT NULL)""", {"neighbours": _NEIGHBOURS}),
)
def _(v):
    rows = neighbours(v).select(
        "post_id", text.entity_keys(F.col("original_text")).alias("a"), text.entity_keys(F.col("before.text")).alias("b")
    )
    return rows.select("post_id", text.set_overlap(F.col("a"), F.col("b")).alias("overlap"))


@query("infer_category", "H8", d.sql(f"SELECT post_id, {d.first_hit('original_text', text.CATEGORY_PATTERNS, d.q('IRAN'))} AS category FROM raw_posts"))
def _(v):
    return v.raw_posts.select("post_id", text.infer_category(F.col("original_text")).alias("category"))


@query("category_hints", "H9", d.sql(f"SELECT post_id, array_to_string({d.all_hits('original_text', text.HINT_PATTERNS)}, ',') AS hints FROM raw_posts"))
def _(v):
    return v.raw_posts.select("post_id", text.category_hints(F.col("original_text")).alias("hints"))


def _decoded(expr: str) -> str:
    out = f"regexp_replace({expr}, '<br\\s*/?>', chr(10), 'gi')"
    out = f"regexp_replace({out}, '<[^>]+>', '', 'g')"
    for pattern, plain in html.ENTITIES:
        out = f"regexp_replace({out}, {d.q(pattern.replace('(?i)', ''))}, {d.q(plain)}, 'gi')" if "(?i)" in pattern else f"regexp_replace({out}, {d.q(pattern)}, {d.q(plain)}, 'g')"
    return out


@query(
    "strip_html", "H10",
    d.sql(f"""SELECT page_id, length(t) AS chars, sha256(t) AS text_hash FROM
        (SELECT page_id, {d.trim("list_reduce(list_prepend(x, list_distinct(regexp_extract_all(x, '&#[0-9]+;'))), lambda acc, e: replace(acc, e, chr(CAST(regexp_extract(e, '[0-9]+') AS INTEGER))))")} AS t
         FROM (SELECT page_id, {_decoded('html')} AS x FROM pages))"""),
)
def _(v):
    t = html.html_text(F.col("html"))
    return v.table("pages").withColumn("t", t).select("page_id", F.char_length("t").alias("chars"), F.sha2("t", 256).alias("text_hash"))


@query("cited_source", "H12", d.sql("SELECT coalesce(cited_source, 'none') AS outlet, count(*) AS posts FROM posts GROUP BY 1"))
def _(v):
    outlet = F.coalesce(origin.cited_source(F.col("original_text")), F.lit("none"))
    return v.raw_posts.groupBy(outlet.alias("outlet")).agg(F.count("*").alias("posts"))


@query(
    "origin_of_posts", "H15 H16 H17 C12",
    d.sql(f"""SELECT p.post_id, {d.group_of()} AS origin_group, {d.KIND} AS origin_type,
                 CASE {d.KIND} WHEN 'unknown' THEN 0.55::DOUBLE ELSE 0.8::DOUBLE END AS relationship_confidence
              FROM posts p JOIN sources s ON s.source_id = p.source_id"""),
)
def _(v):
    joined = v.posts.join(v.sources, "source_id")
    kind = origin.origin_type(F.col("metadata"), F.col("is_wire_origin"), F.col("role"))
    return joined.withColumn("origin_type", kind).select(
        "post_id",
        origin.origin_group(F.col("metadata"), F.col("is_wire_origin"), F.col("source_key"), F.col("source_id")).alias("origin_group"),
        "origin_type",
        origin.relationship_confidence(F.lit(False), F.col("origin_type")).alias("relationship_confidence"),
    )


@query("fold_origin", "H15", d.sql(f"SELECT url AS raw_origin, {d.fold('url')} AS origin FROM pages"))
def _(v):
    return v.table("pages").select(F.col("url").alias("raw_origin"), origin.fold_origin(F.col("url")).alias("origin"))


@query("refuting_posts", "H18", d.sql(f"SELECT source_id, count(*) FILTER ({d.has('normalized_text', text.REFUTATION_PATTERN)}) AS refuting, count(*) AS posts FROM posts GROUP BY 1"))
def _(v):
    denies = text.refutes(text.normalize_text(F.col("original_text")))
    return v.raw_posts.groupBy("source_id").agg(F.count_if(denies).alias("refuting"), F.count("*").alias("posts"))


def _place_form(expr: str) -> str:
    out = f"translate({expr}, {d.q(places.FOLD_FROM)}, {d.q(places.FOLD_TO)})"
    out = f"regexp_replace(regexp_replace({out}, {d.q(places.DROPPED)}, '', 'g'), {d.q(places.JOINERS)}, ' ', 'g')"
    return f"trim(regexp_replace(lower({out}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _place_hits(expr: str) -> str:
    """Most specific places: a place is dropped when one inside it is named too."""
    named = {p.node: " OR ".join(f"contains({expr}, {d.q(f' {a} ')})" for a in p.aliases) for p in places.PLACES}
    chains = places.ancestors()
    items = []
    for node, hit in named.items():
        below = [named[n] for n, chain in chains.items() if node in chain[1:]]
        inside = " OR ".join(f"({b})" for b in below) or "false"
        items.append(f"CASE WHEN ({hit}) AND NOT ({inside}) THEN {d.q(node)} END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


_PLACED = f"SELECT post_id, source_id, published_at, {_place_hits('padded')} AS places FROM (SELECT *, ' ' || {_place_form('normalized_text')} || ' ' AS padded FROM posts)"


@query("explicit_places", "H19 H20", d.sql("SELECT post_id, array_to_string(places, ',') AS places FROM placed", {"placed": _PLACED}))
def _(v):
    return v.posts.select("post_id", places.explicit_places(F.col("normalized_text")).alias("places"))


@query(
    "posts_within_places", "C13 H20",
    d.sql("""SELECT within, count(*) AS mentions, count(DISTINCT post_id) AS posts FROM (
              SELECT post_id, unnest(CASE place WHEN 'iran' THEN ['iran'] WHEN 'sadeghieh' THEN ['sadeghieh', 'tehran', 'iran'] ELSE [place, 'iran'] END) AS within
              FROM (SELECT post_id, unnest(places) AS place FROM placed)) GROUP BY within""", {"placed": _PLACED}),
)
def _(v):
    named = v.posts.select("post_id", F.explode(places.explicit_places(F.col("normalized_text"))).alias("place"))
    up = named.join(F.broadcast(places.place_closure(v.spark)), "place")
    per_post = up.groupBy("within", "post_id").agg(F.count("*").alias("n"))
    return per_post.groupBy("within").agg(F.sum("n").alias("mentions"), F.count("*").alias("posts"))


@query("gazetteer_places", "H20 C13", d.sql("SELECT post_id, unnest(places) AS node FROM placed", {"placed": _PLACED}))
def _(v):
    return gazetteer.named_places(v.posts, gazetteer.gazetteer_of(v.spark), "post_id", F.col("normalized_text"))


@query("gazetteer_mentions", "C13 H20", QUERIES["posts_within_places"].sql)
def _(v):
    table = gazetteer.gazetteer_of(v.spark)
    named = gazetteer.named_places(v.posts, table, "post_id", F.col("normalized_text"))
    return gazetteer.mentions_within(named, table, "post_id")


@query(
    "place_contradictions", "H21",
    d.sql("""SELECT post_id, len(places) > 0 AND len(before) > 0 AND NOT list_has_any(up, before) AND NOT list_has_any(places, before_up) AS contradicts FROM (
          SELECT post_id, places, lag(places) OVER w AS before, up, lag(up) OVER w AS before_up FROM (
            SELECT *, flatten(list_transform(places, lambda p: CASE p WHEN 'iran' THEN ['iran'] WHEN 'sadeghieh' THEN ['sadeghieh', 'tehran', 'iran'] ELSE [p, 'iran'] END)) AS up FROM placed)
          WINDOW w AS (PARTITION BY source_id ORDER BY published_at, post_id)) WHERE before IS NOT NULL""", {"placed": _PLACED}),
)
def _(v):
    rows = v.posts.select("post_id", "source_id", "published_at", places.explicit_places(F.col("normalized_text")).alias("places"))
    pairs = previous_value(
        rows, ["source_id"], ["published_at", "post_id"], time_block(F.col("published_at")), F.col("places"), "before"
    ).filter("before is not null")
    return pairs.select("post_id", places.places_contradict(F.col("places"), F.col("before")).alias("contradicts"))


@query(
    "language_profiles", "H22",
    d.sql("SELECT regexp_matches(original_text, '[؀-ۿ]') AS persian, regexp_matches(original_text, '[A-Za-z]') AS latin, count(*) AS posts FROM raw_posts GROUP BY 1, 2"),
)
def _(v):
    t = F.col("original_text")
    return v.raw_posts.groupBy(text.has_persian(t).alias("persian"), text.has_latin(t).alias("latin")).agg(F.count("*").alias("posts"))


@query("ellipsize", "H23", d.sql(f"SELECT post_id, CASE WHEN length(t) > 180 THEN left(t, 179) || '…' ELSE t END AS cut FROM (SELECT post_id, {d.flat('original_text')} AS t FROM raw_posts)"))
def _(v):
    return v.raw_posts.select("post_id", text.ellipsize(F.col("original_text"), 180).alias("cut"))


_LABEL = "CASE verification_status " + " ".join(f"WHEN {d.q(k)} THEN {d.q(x)}" for k, x in caption.STATUS_LABELS.items()) + f" ELSE {d.q(caption.STATUS_LABEL_ELSE)} END"
_TITLE = "CASE WHEN length(t) <= 140 THEN t ELSE left(t, 137) || '…' END"
_BODY = f"left(core_fact || chr(10) || '{caption.STATUS_TITLE}: ' || {_LABEL} || ' | {caption.CONFIRMATION_TITLE}: ' || independent_confirmation_count, 1000)"


@query(
    "fallback_stories", "H26 B19",
    d.sql(f"""SELECT event_id, title, sha256(description) AS description_hash,
        length(regexp_replace(title, '[^؀-ۿ]', '', 'g')) >= 5 AND length(regexp_replace(title, '[^؀-ۿ]', '', 'g')) >= length(regexp_replace(title, '[^A-Za-z]', '', 'g'))
        AND length(regexp_replace(description, '[^؀-ۿ]', '', 'g')) >= 5 AND length(regexp_replace(description, '[^؀-ۿ]', '', 'g')) >= length(regexp_replace(description, '[^A-Za-z]', '', 'g')) AS persian
        FROM (SELECT event_id, {_TITLE} AS title, {_BODY} AS description FROM (SELECT *, {d.flat('core_fact')} AS t FROM event_rows))"""),
)
def _(v):
    title = caption.fallback_title(F.col("core_fact"))
    body = caption.fallback_description(F.col("core_fact"), F.col("verification_status"), F.col("independent_confirmation_count"))
    rows = v.events.select("event_id", title.alias("title"), body.alias("body"))
    return rows.select(
        "event_id", "title", F.sha2("body", 256).alias("description_hash"), caption.story_is_persian(F.col("title"), F.col("body")).alias("persian")
    )


_SP = f"[{text.SPACES}]"


def _clean_line(x):
    return d.trim(f"regexp_replace(regexp_replace(regexp_replace({x}, {d.q('^' + caption.CAMERA + _SP + '*')}, ''), {d.q('(^|' + _SP + ')@[A-Za-z0-9_]{3,}')}, '\\1', 'g'), '[ \t]{{2,}}', ' ', 'g')")


_STATUS_LINE = d.q(f"^(?:{caption.STATUS_TITLE}|{caption.CONFIRMATION_TITLE}){_SP}*[:：]")
_CLEANED = {
    "told": f"""SELECT *, {d.trim("replace(replace(title, chr(13) || chr(10), ''), chr(13), '')")} AS given, {_clean_line('title')} AS shown,
        {d.trim("replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10))")} AS whole FROM drafted""",
    "rest": f"""SELECT *, CASE WHEN starts_with(whole, given) THEN {d.trim("substr(whole, length(given) + 1)")}
        WHEN starts_with(regexp_replace(whole, {d.q(_SP + '+')}, ' ', 'g'), {d.flat('shown')}) THEN {d.trim("substr(whole, length(shown) + 1)")} ELSE whole END AS r FROM told""",
    "cleaned": f"""SELECT *, {_clean_line(d.trim(f"array_to_string(list_filter(string_split(r, chr(10)), lambda l: NOT regexp_matches({d.trim('l')}, {_STATUS_LINE})), chr(10))"))} AS description FROM rest""",
}
_FACT_DRAFT = f"SELECT *, {_TITLE} AS plain, {_BODY} AS told_body FROM (SELECT *, {d.flat('core_fact')} AS t FROM event_rows)"
_MARKED = {
    "fact_drafts": _FACT_DRAFT,
    "drafted": """SELECT event_id, title, title || chr(10) || told_body AS body FROM (
        SELECT *, CASE WHEN event_id % 2 = 0 THEN '🎥 ' ELSE '' END || '@channel_one ' || plain AS title FROM fact_drafts)""",
    **_CLEANED,
}


@query("clean_captions", "H24", d.sql("SELECT event_id, shown AS title, description FROM cleaned", _MARKED))
def _(v):
    camera = F.when(F.col("event_id") % 2 == 0, F.lit("🎥 ")).otherwise(F.lit(""))
    title = F.concat(camera, F.lit("@channel_one "), caption.fallback_title(F.col("core_fact")))
    body = F.concat(title, F.lit("\n"), caption.fallback_description(F.col("core_fact"), F.col("verification_status"), F.col("independent_confirmation_count")))
    return v.events.select("event_id", title.alias("title"), body.alias("body")).select(
        "event_id", caption.clean_line(F.col("title")).alias("title"), caption.clean_description(F.col("title"), F.col("body")).alias("description")
    )


def _escaped(x):
    for plain, escaped in caption.HTML_ESCAPES:
        x = f"replace({x}, {d.q(plain)}, {d.q(escaped)})"
    return x


_RENDERED = {
    "fact_drafts": _FACT_DRAFT,
    "drafted": "SELECT *, plain AS title, told_body AS body FROM fact_drafts",
    **_CLEANED,
    "parts": f"""SELECT *, '{caption.STATUS_TITLE}: ' || {_LABEL} AS status_line, '{caption.CONFIRMATION_TITLE}: ' || translate(independent_confirmation_count::VARCHAR, '0123456789', '{caption.PERSIAN_DIGITS}') AS confirmation_line,
        array_to_string(list_transform({d.all_hits('core_fact', text.ENTITY_PATTERNS)}, lambda k: '#' || regexp_replace(k, {d.q(_SP + '+')}, '_', 'g')), ' ') AS hashtags FROM cleaned""",
    "budgeted": """SELECT *, greatest(0, 900 - (length(shown) + length(status_line) + length(confirmation_line) + length(hashtags) + 2 * len(list_filter([shown, status_line, confirmation_line, hashtags], lambda x: x <> '')))) AS room FROM parts""",
    "cut": """SELECT *, CASE WHEN length(description) <= room THEN description WHEN room <= 0 THEN '' WHEN room = 1 THEN '…' ELSE left(description, room - 1) || '…' END AS kept FROM budgeted""",
}


@query(
    "render_captions", "H25",
    d.sql(f"""SELECT event_id, chr(8207) || concat_ws(chr(10) || chr(10), '<b>' || {_escaped('shown')} || '</b>', nullif({_escaped('kept')}, ''), status_line, confirmation_line, nullif({_escaped('hashtags')}, '')) AS caption FROM cut""", _RENDERED),
)
def _(v):
    title = caption.fallback_title(F.col("core_fact"))
    body = caption.fallback_description(F.col("core_fact"), F.col("verification_status"), F.col("independent_confirmation_count"))
    drafts = v.events.select(
        "event_id", title.alias("title"), body.alias("body"), "verification_status", "independent_confirmation_count",
        text.entity_keys(F.col("core_fact")).alias("tags"),
    )
    shown = caption.render_caption(
        F.col("title"), F.col("body"), F.col("verification_status"), F.col("independent_confirmation_count"), F.col("tags")
    )
    return drafts.select("event_id", shown.alias("caption"))


@query(
    "split_routes", "H28",
    d.sql("""SELECT page_id, CASE WHEN contains(url, '/') THEN nullif(split_part(url, '/', 1), '') ELSE url END AS provider,
             CASE WHEN contains(url, '/') THEN nullif(substr(url, instr(url, '/') + 1), '') END AS model FROM pages"""),
)
def _(v):
    provider, model = jsonfn.split_route(F.col("url"))
    return v.table("pages").select("page_id", provider.alias("provider"), model.alias("model"))


@query(
    "redact_secrets", "H29",
    d.sql(f"""SELECT doc_id, sha256(regexp_replace(replace(t, source, '[REDACTED]'), {d.q(f'Bearer[{text.SPACES}]+[^{text.SPACES}"' + chr(39) + ']+')}, 'Bearer [REDACTED]', 'gi')) AS shown
              FROM (SELECT doc_id, source, 'call by ' || source || ' with bearer ' || text || ' end' AS t FROM documents)"""),
)
def _(v):
    t = F.concat(F.lit("call by "), "source", F.lit(" with bearer "), "text", F.lit(" end"))
    return v.table("documents").select("doc_id", F.sha2(text.redact(t, F.col("source")), 256).alias("shown"))


@query(
    "parse_lists", "H30 G5",
    d.sql(f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: {d.trim('x')}), lambda x: x <> ''), '|') AS items,
         array_to_string(list_sort(list_distinct([doc_id % 7 + 1, doc_id % 5 + 1, doc_id % 3 + 1])), ',') AS ids FROM documents"""),
)
def _(v):
    n = F.col("doc_id")
    listed = F.concat_ws(",", (n % 7 + 1).cast("string"), F.lit(" "), (n % 5 + 1).cast("string"), (-n).cast("string"), (n % 3 + 1).cast("string"))
    return v.table("documents").select(
        "doc_id",
        F.array_join(text.parse_list(F.col("text")), "|").alias("items"),
        text.unique_positive_ids(text.parse_id_list(listed)).alias("ids"),
    )


@query(
    "batch_windows", "H32",
    d.sql("""SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%dT%H:%M') AS window_end,
             strftime(time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE, '%Y-%m-%dT%H:%M') AS window_start, count(*) AS n FROM log GROUP BY 1, 2"""),
)
def _(v):
    minute = "yyyy-MM-dd'T'HH:mm"
    return v.log.groupBy(
        F.date_format(timefn.window_end(F.col("ts")), minute).alias("window_end"),
        F.date_format(timefn.window_start(F.col("ts")), minute).alias("window_start"),
    ).agg(F.count("*").alias("n"))


@query("event_ages", "H33 H34", d.sql(f"SELECT event_id, greatest(0.0::DOUBLE, (epoch_us({d.NOW}) - epoch_us(first_seen_at))::DOUBLE / 3600000000.0::DOUBLE) AS hours, strftime(first_seen_at, '%Y-%m-%d') AS day FROM event_rows"))
def _(v):
    return v.events.select(
        "event_id", timefn.age_hours(F.col("first_seen_at"), now()).alias("hours"), timefn.day_key(F.col("first_seen_at")).alias("day")
    )


@query("content_hashes", "H14", d.sql("SELECT post_id, sha256(canonical_url || chr(10) || original_text || chr(10)) AS content_hash FROM raw_posts"))
def _(v):
    return v.raw_posts.select(
        "post_id", html.content_hash(F.col("canonical_url"), F.col("original_text"), F.lit(None).cast("string")).alias("content_hash")
    )


@query(
    "compact_reports", "B22",
    d.sql("""SELECT post_id, least(length(normalized_text), 1800) AS chars, sha256(left(normalized_text, 1800)) AS text_hash FROM posts"""),
)
def _(v):
    report = text.compact_report(
        F.col("post_id"), F.col("source_id"), F.lit("n"), F.col("published_at"), F.col("observed_at"), F.col("normalized_text"), F.col("original_text")
    )
    back = F.from_json(report, "post_id bigint, text string")
    return v.posts.select(back.alias("r")).select(
        "r.post_id", F.char_length("r.text").alias("chars"), F.sha2("r.text", 256).alias("text_hash")
    )


# --- JSON --------------------------------------------------------------------
def responses(v):
    """Model response bodies in every supported shape, around document texts."""
    n = F.col("doc_id")
    inner = F.to_json(F.struct(n.alias("id"), F.col("source").alias("src")))
    quoted = F.to_json(F.struct(F.col("x").alias("t")))
    prose = F.concat(F.lit("Answer: "), inner, F.lit(" done"))
    fenced = F.concat(F.lit("```json\n"), inner, F.lit("\n```"))
    said = F.when(n % 5 == 0, inner).when(n % 5 == 1, fenced).when(n % 5 == 2, prose).when(n % 5 == 3, F.lit("no json")).otherwise(inner)
    as_json = F.regexp_replace(F.regexp_replace(quoted, '^\\{"t":', ""), "\\}$", "")
    rows = v.table("documents").select("doc_id", inner.alias("inner"), said.alias("x")).withColumn("s", as_json)
    body = (
        F.when(n % 7 == 0, F.concat(F.lit('{"response":'), "inner", F.lit("}")))
        .when(n % 7 == 1, F.concat(F.lit('{"result":{"response":'), "inner", F.lit("}}")))
        .when(n % 7 == 2, F.concat(F.lit('{"result":'), "inner", F.lit("}")))
        .when(n % 7 == 3, F.concat(F.lit('{"choices":[{"message":{"content":'), "s", F.lit('},"finish_reason":"stop"}]}')))
        .when(n % 7 == 4, F.concat(F.lit('{"choices":[{"message":{"content":'), "inner", F.lit('},"finish_reason":7}]}')))
        .when(n % 7 == 5, F.concat(F.lit('{"choices":[{"message":{"content":[{"text":'), "s", F.lit('},{"n":1}]}}],"usage":{"prompt_tokens":'), n.cast("string"), F.lit("}}")))
        .otherwise(F.concat(F.lit('{"response":'), "s", F.lit("}")))
    )
    return rows.withColumn("body", body)


@query(
    "unwrap_responses", "H41 H42",
    d.sql("""SELECT doc_id, CASE WHEN doc_id % 7 IN (3, 5, 6) AND doc_id % 5 = 3 THEN 'null' ELSE doc_id::VARCHAR END AS answer_id,
             CASE WHEN doc_id % 7 IN (3, 5, 6) AND doc_id % 5 = 3 THEN 'null' ELSE source END AS answer_source FROM documents"""),
)
def _(v):
    answer = jsonfn.unwrap_response(F.col("body"))
    return responses(v).withColumn("answer", answer).select(
        "doc_id",
        F.coalesce(F.get_json_object("answer", "$.id"), F.lit("null")).alias("answer_id"),
        F.coalesce(F.get_json_object("answer", "$.src"), F.lit("null")).alias("answer_source"),
    )


@query(
    "response_usage", "H44",
    d.sql("""SELECT doc_id, CASE WHEN doc_id % 7 = 5 THEN doc_id::DOUBLE ELSE 0.0::DOUBLE END AS prompt_tokens,
             CASE doc_id % 7 WHEN 3 THEN 'stop' WHEN 4 THEN 'none' WHEN 5 THEN 'none' ELSE '' END AS finish FROM documents"""),
)
def _(v):
    reasons = F.transform(jsonfn.finish_reasons(F.col("body")), lambda r: F.coalesce(r, F.lit("none")))
    return responses(v).select("doc_id", jsonfn.usage_tokens(F.col("body"), "prompt_tokens").alias("prompt_tokens"), reasons.alias("finish"))


@query("props_metadata", "H40", d.sql("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, '' AS missing FROM events"))
def _(v):
    as_text = F.replace("props", F.lit('"k": '), F.lit('"k": "'))
    as_text = F.replace(as_text, F.lit("}"), F.lit('"}'))
    return v.log.select(
        "event_id",
        F.coalesce(jsonfn.meta_string(as_text, "k"), F.lit("")).alias("k"),
        F.coalesce(jsonfn.meta_string(F.col("props"), "k"), F.lit("")).alias("missing"),
    )


@query(
    "failure_classes", "H39",
    d.sql("""SELECT coalesce(c, 'ok') AS failure, count(*) AS calls FROM (SELECT CASE
        WHEN error_code LIKE '%json_invalid%' THEN 'structured_json_invalid' WHEN error_code LIKE '%schema_invalid%' THEN 'structured_schema_invalid'
        WHEN error_code LIKE '%timeout%' THEN 'upstream_timeout' WHEN status = 429 OR error_code LIKE '%rate_limit%' THEN '429'
        WHEN error_code LIKE '%auth%' THEN 'auth' WHEN error_code LIKE '%model-unavailable%' THEN 'model_unavailable'
        WHEN error_code LIKE '%provider_error%' THEN 'provider_error' WHEN status BETWEEN 500 AND 599 THEN 'provider_5xx'
        WHEN status BETWEEN 200 AND 299 AND NOT structured THEN 'structured_json_invalid'
        WHEN status BETWEEN 200 AND 299 AND NOT schema_valid THEN 'structured_schema_invalid'
        WHEN NOT contract_valid THEN 'structured_schema_invalid' WHEN status <> 200 THEN 'other' END AS c FROM calls) GROUP BY 1"""),
)
def _(v):
    c = jsonfn.failure_class(F.col("status"), F.col("error_code"), F.col("structured"), F.col("schema_valid"), ~F.col("contract_valid"))
    return v.calls.groupBy(F.coalesce(c, F.lit("ok")).alias("failure")).agg(F.count("*").alias("calls"))


@query(
    "benchmark_failures", "H39",
    d.sql("""SELECT coalesce(c, 'ok') AS failure, count(*) AS calls FROM (SELECT CASE
        WHEN status IS NULL THEN 'HTTP_FAILURE' WHEN NOT status BETWEEN 200 AND 299 AND (status IN (408, 504) OR error_code LIKE '%upstream_timeout%') THEN 'TIMEOUT'
        WHEN NOT status BETWEEN 200 AND 299 THEN 'HTTP_FAILURE' WHEN completion_tokens > 80 THEN 'TRUNCATED' WHEN NOT structured THEN 'INVALID_JSON'
        WHEN NOT schema_valid THEN 'SCHEMA_INVALID' WHEN NOT contract_valid THEN 'ZOD_INVALID'
        WHEN missing_posts = 1 THEN 'MISSING_POST_COVERAGE' WHEN missing_posts = 2 THEN 'OTHER' END AS c FROM calls) GROUP BY 1"""),
)
def _(v):
    first_code = F.when(F.col("missing_posts") == 1, F.lit("missing_post_coverage")).when(F.col("missing_posts") == 2, F.lit("unlisted"))
    c = jsonfn.benchmark_failure(
        F.col("status"), F.lit(False), F.col("error_code"), F.coalesce(F.col("completion_tokens") > 80, F.lit(False)),
        F.col("structured"), F.col("schema_valid"), F.col("contract_valid"), first_code,
    )
    return v.calls.groupBy(F.coalesce(c, F.lit("ok")).alias("failure")).agg(F.count("*").alias("calls"))


@query("clamp_scores", "H35", d.sql("SELECT event_id, least(100, greatest(0, CAST(floor(value - 20 + 0.5::DOUBLE) AS BIGINT))) AS score FROM events"))
def _(v):
    return v.log.select("event_id", scoring.clamp(F.col("value") - 20).alias("score"))


@query(
    "link_rows", "H27",
    d.sql("""SELECT story, k // 2 AS row_no, string_agg(left(label, 32) || '=' || url, ' | ' ORDER BY k) AS buttons
             FROM (SELECT *, row_number() OVER (PARTITION BY story ORDER BY first_post) - 1 AS k
                   FROM (SELECT (post_id - 1) // 8 AS story, 'https://t.me/c' || (source_id % 5) AS url, arg_min('Channel ' || source_id, post_id) AS label, min(post_id) AS first_post
                         FROM raw_posts GROUP BY 1, 2)) GROUP BY 1, 2"""),
)
def _(v):
    """Link rows of the posts of each packed batch of eight."""
    link = F.struct("post_id", F.col("source_id").alias("s"))
    grouped = v.raw_posts.groupBy(F.floor((F.col("post_id") - 1) / 8).alias("story")).agg(F.array_sort(F.collect_list(link)).alias("ls"))
    links = F.transform(
        "ls",
        lambda x: F.struct(
            F.concat(F.lit("Channel "), x["s"].cast("string")).alias("label"),
            F.concat(F.lit("https://t.me/c"), (x["s"] % 5).cast("string")).alias("url"),
        ),
    )
    rows = grouped.select("story", F.posexplode(caption.link_rows(links)).alias("row_no", "row"))
    return rows.select("story", "row_no", F.array_join(F.transform("row", lambda b: F.concat(b["text"], F.lit("="), b["url"])), " | ").alias("buttons"))
