import random

import pytest
from pyspark.sql import functions as F

from corroborate.functions import caption, html, jsonfn, origin, places, scoring, text, timefn

S = F.col("s")


def test_normalize_folds_letters_and_spaces(value):
    raw = " كتاب  علي\t\n،  سلام !﻿ "
    assert value(text.normalize_text(S), s=raw) == "کتاب علی، سلام!"


@pytest.mark.parametrize(
    "raw, reason",
    [
        ("", "empty"),
        ("short text", "too_short"),
        ("please JOIN OUR CHANNEL for more updates", "promotion_or_advertisement"),
        ("برای تبلیغات با ما تماس بگیرید لطفا", "promotion_or_advertisement"),
        ("the ministers met again on Tuesday", None),
    ],
)
def test_noise(value, raw, reason):
    assert value(text.noise_reason(text.normalize_text(S)), s=raw) == reason


def test_overlap_of_four_word_texts(value):
    a, b = text.tokens(F.col("a")), text.tokens(F.col("b"))
    assert value(text.set_overlap(a, b), a="fire closes northern port", b="fire closes northern road") == 0.75
    assert value(text.set_overlap(a, b), a="", b="word") == 0.0


def test_copy_score_of_equal_texts(value):
    t = text.tokens(S)
    assert value(text.copy_score(t, t, F.lit(1.0)), s="alpha beta gamma") == pytest.approx(1.0)


def test_category_order_and_substring_match(value):
    assert value(text.infer_category(S), s="market under attack") == "ECONOMY"
    assert value(text.infer_category(S), s="he said so") == "TECHNOLOGY"
    assert value(text.infer_category(S), s="nothing here") == "IRAN"


def test_entities_in_table_order(value):
    assert value(text.entity_keys(S), s="OpenAI and Iran, تهران") == ["iran", "tehran", "openai"]


@pytest.mark.parametrize("raw, hit", [("it was DENIED", True), ("رد  شد", True), ("confirmed", False)])
def test_refutation(value, raw, hit):
    assert value(text.refutes(S), s=raw) is hit


def test_html_text(value):
    raw = "a<br/>b &amp;lt; &#x27;q&#X2f; &#1575;&#128512; <b>x</b>&nbsp;"
    assert value(html.html_text(S), s=raw) == "a\nb &lt; 'q/ ا😀 x"


def test_forwarded_from_near_and_in_class(value):
    direct = '<a class="tgme_widget_message_forwarded_from_name" href="https://t.me/agency/12">'
    near = '<div class="tgme_widget_message_forwarded_from"> by <a href="https://t.me/other?x">'
    assert value(html.forwarded_from(S), s=direct) == "agency"
    assert value(html.forwarded_from(S), s=near) == "other"
    assert value(html.forwarded_from(S), s="<p>") is None


@pytest.mark.parametrize(
    "raw, outlet",
    [
        ("storm nears, according to Reuters", "reuters"),
        ("Reuters building damaged", None),
        ("به نقل از ایرنا", None),
        ("به نقل از خبرگزاری تسنیم", "tasnim"),
        ("reports from AP say", "ap"),
        ("reports from APPLE say", None),
        ("منبع: IRNA", "irna"),
    ],
)
def test_cited_source(value, raw, outlet):
    assert value(origin.cited_source(S), s=raw) == outlet


@pytest.mark.parametrize("raw, folded", [(" @irna_1313 ", "irna"), ("Associated  Press", "ap"), ("Some-Blog", "some_blog"), ("x" * 90, "x" * 80)])
def test_fold_origin(value, raw, folded):
    assert value(origin.fold_origin(S), s=raw) == folded


def group_and_type(value, **columns):
    columns = {"m": "{}", "wire": False, "key": "k", "id": 7, "role": "specialist", "copied": None, **columns}
    group = origin.origin_group(F.col("m"), F.col("wire"), F.col("key"), F.col("id"), F.col("copied").cast("string"))
    kind = origin.origin_type(F.col("m"), F.col("wire"), F.col("role"))
    return tuple(value(F.struct(group, kind), **columns))


def test_origin_priority(value):
    both = '{"forwarded_from":"@irna_1313","cited_source":"reuters"}'
    assert group_and_type(value, m=both) == ("origin:irna", "forward_repost")
    assert group_and_type(value, m='{"cited_source":"Reuters"}') == ("origin:reuters", "wire_republish")
    assert group_and_type(value, copied="origin:x") == ("origin:x", "unknown")
    assert group_and_type(value, wire=True) == ("origin:k", "original_reporting")
    assert group_and_type(value, m="[1]", role="aggregator") == ("source:7", "aggregation")
    assert group_and_type(value, m='{"forwarded_from":5}', role="primary_source") == ("source:7", "forward_repost")
    assert group_and_type(value, m="broken {") == ("source:7", "unknown")


@pytest.mark.parametrize(
    "raw, found",
    [
        ("clashes in Tehran, Iran", ["tehran"]),
        ("Iran talks", ["iran"]),
        ("حادثه در فلکه دوم صادقیه تهران", ["sadeghieh"]),
        ("tehranian food", []),
        ("آمُل و مشهــد", ["amol", "mashhad"]),
    ],
)
def test_explicit_places(value, raw, found):
    assert value(places.explicit_places(S), s=raw) == found


@pytest.mark.parametrize(
    "left, right, veto",
    [
        (["tehran"], ["mashhad"], True),
        (["tehran"], ["sadeghieh"], False),
        (["iran"], ["amol"], False),
        ([], ["amol"], False),
        (["amol", "tehran"], ["tehran"], False),
    ],
)
def test_place_contradiction(spark, left, right, veto):
    frame = spark.createDataFrame([(left, right)], "l array<string>, r array<string>")
    assert frame.select(places.places_contradict(F.col("l"), F.col("r"))).first()[0] is veto


def test_nfkc_presentation_forms(value):
    assert value(places.normalize_place(S), s="ﺗﻬﺮﺍﻥ") == "تهران"


@pytest.mark.parametrize(
    "body, answer",
    [
        ('{"response":{"a":1}}', '{"a":1}'),
        ('{"result":{"response":{"a":2}}}', '{"a":2}'),
        ('{"result":{"b":3}}', '{"b":3}'),
        ('{"choices":[{"message":{"content":"```json\\n{\\"a\\":4}\\n```"}}]}', '{"a":4}'),
        ('{"choices":[{"message":{"content":[{"text":"x {\\"a\\""},{"text":":5} y"}]}}]}', '{"a":5}'),
        ('{"response":"say {\\"a\\":6} now"}', '{"a":6}'),
        ('{"response":"{\\"a\\":1} and {\\"b\\":2}"}', None),
        ("[1]", None),
        ("not json", None),
    ],
)
def test_unwrap_response(value, body, answer):
    assert value(jsonfn.unwrap_response(S), s=body) == answer


def test_split_route(value):
    provider, model = jsonfn.split_route(S)
    assert tuple(value(F.struct(provider, model), s=" a/b/c ")) == ("a", "b/c")
    assert tuple(value(F.struct(provider, model), s="solo")) == ("solo", None)
    assert tuple(value(F.struct(provider, model), s=" ")) == (None, None)


def test_gateway_error_and_attempts(value):
    body = '{"error":{"code":"c1","message":" m ","attempts":[{"route":"p/m","status":502,"error":{"code":"e"}},{"provider":"q"}]}}'
    rows = value(jsonfn.gateway_attempts(S), s=body)
    assert [tuple(r) for r in rows] == [("p", "m", 502, "e", None), ("q", None, None, None, None)]
    assert tuple(value(jsonfn.gateway_error(S), s=body)) == ("c1", "m")
    assert value(jsonfn.gateway_attempts(S), s="{}") == []


def test_redact(value):
    shown = value(text.redact(S, F.lit("k-1")), s="key k-1, Bearer  abc.def'")
    assert shown == "key [REDACTED], Bearer [REDACTED]'"


def test_persian_gate(value):
    assert value(text.is_persian(S), s="خبر مهم امروز AI") is True
    assert value(text.is_persian(S), s="خبر English words here") is False


def test_truncation_counts_code_points(value):
    assert value(text.truncate_chars(S, F.lit(3)), s="😀😀😀😀") == "😀😀…"
    assert value(text.truncate_chars(S, F.lit(0)), s="abc") == ""
    assert value(text.ellipsize(S, 4), s="a  b\nc d") == "a b…"


def test_caption(spark):
    row = spark.createDataFrame(
        [("🎥 عنوان خبر @channel", "عنوان خبر\nوضعیت: x\nمتن <b>", "CONFIRMED", 12, ["a b"])],
        "t string, d string, s string, n int, tags array<string>",
    )
    shown = row.select(caption.render_caption(F.col("t"), F.col("d"), F.col("s"), F.col("n"), F.col("tags"))).first()[0]
    assert shown == "‏<b>عنوان خبر</b>\n\nمتن &lt;b&gt;\n\nوضعیت: تأییدشده\n\nتأیید مستقل: ۱۲\n\n#a_b"


def test_caption_budget(spark):
    row = spark.createDataFrame([("t", "x" * 5000)], "t string, d string")
    shown = row.select(caption.render_caption(F.col("t"), F.col("d"), F.lit("DISPUTED"), F.lit(1), F.array().cast("array<string>"))).first()[0]
    assert len(shown) <= 900 + len("‏<b></b>") and "…" in shown


def test_link_rows(spark):
    links = [("one", "u1"), ("again", "u1"), ("x" * 40, "u2"), ("three", "u3")]
    frame = spark.createDataFrame([(links,)], "l array<struct<label:string,url:string>>")
    rows = frame.select(caption.link_rows(F.col("l"))).first()[0]
    assert [[tuple(b) for b in row] for row in rows] == [[("one", "u1"), ("x" * 32, "u2")], [("three", "u3")]]


def test_scores_and_ceilings(spark):
    # score of a confirmed event of age 0, and the best score each category can reach unaided
    from corroborate.config import CATEGORIES
    from corroborate.operators.editorial import score_events

    rows = [(i, c, s, n) for i, c in enumerate(CATEGORIES) for s in ("CONFIRMED", "DEVELOPING") for n in range(8)]
    events = spark.createDataFrame(rows, "event_id bigint, category string, verification_status string, independent_confirmation_count bigint")
    now = F.lit("2024-01-01").cast("timestamp")
    scored = score_events(events.withColumns({"first_seen_at": now, "event_state": F.lit("active")}), now)
    best = {r[0]: r[1] for r in scored.groupBy("category").agg(F.max("importance_score")).collect()}
    assert best == {"WAR_SECURITY": 83, "POLITICS": 80, "IRAN": 77, "ECONOMY": 76, "SOCIETY": 75, "WORLD": 69, "TECHNOLOGY": 67}
    two = scored.filter("category = 'WAR_SECURITY' and verification_status = 'CONFIRMED' and independent_confirmation_count = 2")
    assert two.select("importance_score", "band").first() == (79, "CANDIDATE")


def test_clamp_rounds_half_up(value):
    assert value(scoring.clamp(S), s=2.5) == 3
    assert value(scoring.clamp(S), s=-3.0) == 0
    assert value(scoring.clamp(S), s=100.6) == 100


def test_windows_and_leases(value):
    at = F.lit("2024-01-01 00:07:32").cast("timestamp")
    assert str(value(timefn.window_end(at))) == "2024-01-01 00:05:00"
    assert str(value(timefn.window_start(at))) == "2024-01-01 00:00:00"
    for minutes, stale in ((5, False), (10, True), (20, True)):
        lease = at - F.expr(f"interval {minutes} minutes")
        assert value(timefn.is_stale(lease, at)) is stale
    assert value(timefn.is_stale(F.lit(None).cast("timestamp"), at)) is True


def test_byte_searches_agree_with_the_patterns_they_stand_before(spark):
    rng = random.Random(11)
    words = ["According to", "reports from", "VIA", "vıa", "ſource", "Key", "MİSSİLE", "mißile", "war", "false", "not  true", "به نقل از", "رد  شد", "Reuters", "AP", "cap", "خبرگزاری فارس", "", "oil"]
    gaps = [" ", "  ", "\n", "\t \r\n", " ", "  ", "\x0b", "\x0c:", "　!", " ،", "﻿.", "\u0085", "‍", "ي", "ۀ"]
    raw = ["".join(rng.choice(gaps) + rng.choice(words) for _ in range(rng.randint(0, 6))) + rng.choice(gaps) for _ in range(600)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in raw], "t string")
    t = F.col("t")
    blanks = F.regexp_replace(F.translate(t, text.FOLD_FROM, text.FOLD_TO), "[\t\r\n ]+", " ")
    closed = F.regexp_replace(blanks, f"{text.SPACE}+([{text.PUNCTUATION}])", "$1")
    pairs = {"normalized": (text.normalize_text(t), F.regexp_replace(closed, f"^{text.SPACE}+|{text.SPACE}+\\z", ""))}
    patterns = [origin.ATTRIBUTION, text.REFUTATION_PATTERN, *(p for ps in (origin.CITED_PATTERNS, text.ENTITY_PATTERNS, text.CATEGORY_PATTERNS, text.HINT_PATTERNS) for _, p in ps)]
    for k, pattern in enumerate([*patterns, "w[a]r|oil", "(?:x|wa)r?", "k+ey|so*urce"]):
        pairs[f"p{k}"] = (text.matches(t, pattern), F.coalesce(t.rlike("(?iu)" + pattern), F.lit(False)))
    wrong = rows.select("t", F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(k)) for k, (a, b) in pairs.items()])).alias("wrong"))
    assert wrong.filter("size(wrong) > 0").collect() == []
    # A next-line character is no white space of a trim, but ends a line for ``$``.
    assert spark.range(1).select(text.trim_spaces(F.lit(" a \u0085"))).first()[0] == "a \u0085"


def test_anchors_are_parts_of_every_alternative():
    assert text.anchors("reports?[ ]+(?:from|by)|via") == ["report", "via"]
    assert text.anchors(r"(?<!\w)AP(?!\w)|Fars News") == ["ap", "fars news"]
    assert text.anchors("a*|b") is None and text.anchors("[ab]") is None


def test_tokens_need_no_normalized_text(spark):
    """Letters are folded; blanks, joiners and punctuation change no token."""
    texts = ["\u064a\u0643 a \u06c0\u0649", "mi\u200dx, co ; x \u061f yy . .zz", "\ufeff \u200c\u200d", "", None, "A\tb\r\nCc\u2028 !dd\u3000:ee 12\u06f3"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    assert rows.filter(~text.tokens(S).eqNullSafe(text.tokens_of(text.normalize_text(S)))).count() == 0
