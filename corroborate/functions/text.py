"""Text functions over columns: normalization, noise, tokens, overlap, keywords.

All of them are compositions of built-in column functions, so they stay inside
whole-stage code generation (array lambdas excepted) and never leave the JVM.
Whitespace follows the Unicode space list below rather than Java's ASCII
``\\s``, and word boundaries are spelled out as ASCII look-arounds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corroborate.config import LIMITS

# --- fixed values -----------------------------------------------------------
# Characters counted as white space.
SPACES = "\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Letter folds: Arabic yeh and alef maksura, kaf, heh with yeh; joiners.
FOLD_FROM = "\u064a\u0649\u0643\u06c0\u200d"
FOLD_TO = "\u06cc\u06cc\u06a9\u0647\u200c"
LETTER_FOLDS = [(a, b) for a, b in zip(FOLD_FROM, FOLD_TO) if a.isalpha()]
PUNCTUATION = "،؛؟!:."
# Advertising phrases.
NOISE_PATTERNS = (
    "عضویت|لینک عضویت|تبلیغ|اسپانسر|برای تبلیغات|تبلیغات",
    "کانال ما را دنبال کنید|ما را دنبال کنید|join our channel",
    "کد تخفیف|خرید کنید|فروش ویژه",
)
MIN_TEXT_CHARS = 18
# Entity keywords, in output order.
ENTITY_PATTERNS = (
    ("iran", "ایران|iran"),
    ("tehran", "تهران|tehran"),
    ("israel", "اسرائیل|اسرائیی|israel"),
    ("united_states", "آمریکا|ایالات متحده|united states|usa"),
    ("russia", "روسیه|russia"),
    ("ukraine", "اوکراین|ukraine"),
    ("gaza", "غزه|gaza"),
    ("dollar", "دلار|دالر|dollar"),
    ("internet", "اینترنت|internet"),
    ("openai", "openai"),
)
# Category keywords; the first match wins.
CATEGORY_PATTERNS = (
    ("ECONOMY", "دلار|ارز|بورس|اقتصاد|تورم|بازار|dollar|market|economy"),
    ("WAR_SECURITY", "جنگ|موشک|حمله|ارتش|امنیت|غزه|جبهه|war|missile|attack|security"),
    ("TECHNOLOGY", "هوش مصنوعی|فناوری|تکنولوژی|openai|ai|technology"),
    ("POLITICS", "دولت|مجلس|رئیس جمهور|انتخابات|government|president|election"),
    ("SOCIETY", "اینترنت|فیلتر|قطعی|زیرساخت|internet|outage"),
)
# Category hints; every match counts.
HINT_PATTERNS = (
    ("WAR_SECURITY", "جنگ|حمله|انفجار|موشک|ارتش|نظامی|war|attack|missile"),
    ("POLITICS", "دولت|رئیس|ترامپ|انتخابات|پارلمان|سیاست|government|president|election"),
    ("ECONOMY", "اقتصاد|بازار|نفت|دلار|بانک|economy|market|oil"),
    ("TECHNOLOGY", "فناوری|اینترنت|هوش مصنوعی|تکنولوژی|technology|software"),
    ("IRAN", "ایران|تهران|خوزستان|هرمز|Iran|Tehran"),
)
# Phrases that deny a report.
REFUTATION_PATTERN = "تکذیب|رد[" + SPACES + "]+شد|جعلی|نادرست|denied|false|fake|not[" + SPACES + "]+true"
# Words ignored when comparing report vocabularies.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "that", "this",
    "در", "از", "به", "با", "برای", "که", "این", "آن",
)
# ----------------------------------------------------------------------------

IGNORE_CASE = "(?iu)"
SPACE = f"[{SPACES}]"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: The characters of ``SPACES``, and those among them that are not collapsed to blanks before punctuation is closed up.
SPACE_CHARS = "".join(c for c in map(chr, range(0x10000)) if re.match(SPACE, c))
OTHER_SPACES = "".join(c for c in SPACE_CHARS if c not in "\t\r\n ")
#: Characters that a case-blind pattern takes for an ASCII letter although their lower case is none.
ODD_CASES = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"))
_PIECE = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\((?:\?<?[=!]|\?:)?|[*+?{}]|.", re.DOTALL)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Conditional branches are outside common subexpression elimination, so a
    long expression used in several branches would run several times.
    """
    return F.transform(F.array(value), body)[0]


def replaced(c: Column, pairs) -> Column:
    """``c`` with each string of ``pairs`` replaced: a search over bytes, which costs far less than ``translate``."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def contains_any(c: Column, parts) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.contains(c, F.lit(part))
    return hit


def anchors(pattern: str) -> list[str] | None:
    """For each alternative of ``pattern`` a plain lower-case part that all its matches hold; None if one has none."""
    found, runs, depth = [], [""], 0
    for piece in [*_PIECE.findall(pattern), "|"]:
        if piece == "|" and not depth:
            found.append(max(runs, key=len))
            runs = [""]
        elif piece[0] == "(" or piece == ")":
            depth += 1 if piece[0] == "(" else -1
            runs.append("")
        elif piece in "*+?{}":
            runs[-1] = runs[-1][:-1]
            runs.append("")
        elif len(piece) > 1 or piece in ".^$" or not (piece.isascii() or piece.lower() == piece.upper()):
            runs.append("")
        elif not depth:
            runs[-1] += piece.lower()
    return found if all(found) else None


def folded(c: Column) -> Column:
    """The form in which ``matches`` looks for anchors."""
    return F.lower(replaced(c, ODD_CASES))


def matches(c: Column, pattern: str, fold: Column | None = None) -> Column:
    """Case-blind search that also folds non-ASCII letters; null never matches.

    A case-blind pattern of many words is slow at every character, so it runs
    only on texts that hold a plain part of one of its alternatives. ``fold``
    is ``folded(c)``, if several patterns share it.
    """
    exact = F.coalesce(c.rlike(IGNORE_CASE + pattern), F.lit(False))
    parts = anchors(pattern)
    if parts is None:
        return exact
    if fold is None:
        return let(folded(c), lambda f: matches(c, pattern, f))
    return F.when(contains_any(fold, parts), exact).otherwise(F.lit(False))


def trim_spaces(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse_spaces(c: Column) -> Column:
    return trim_spaces(F.regexp_replace(c, f"{SPACE}+", " "))


def first_non_empty(*cols: Column) -> Column:
    """The first column that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def normalize_text(c: Column) -> Column:
    """H1: fold letters, collapse blanks, close up punctuation, trim."""
    plain = replaced(c, [*zip(FOLD_FROM, FOLD_TO), ("\t", " "), ("\r", " "), ("\n", " ")])
    def closed(t: Column) -> Column:
        wide = (F.octet_length(t) > F.char_length(t)) & contains_any(t, OTHER_SPACES[2:])
        apart = contains_any(t, [*OTHER_SPACES[:2], *(f" {p}" for p in PUNCTUATION)]) | wide
        return F.when(apart, F.regexp_replace(t, f"{SPACE}+([{PUNCTUATION}])", "$1")).otherwise(t)

    blanks = let(plain, lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t))
    return trim_spaces(let(blanks, closed))


def noise_reason(normalized: Column) -> Column:
    """H2: why a normalized text is noise, or null."""
    return let(
        normalized,
        lambda t: F.when(F.coalesce(t, F.lit("")) == "", F.lit("empty"))
        .when(F.char_length(t) < MIN_TEXT_CHARS, F.lit("too_short"))
        .when(matches(t, "|".join(NOISE_PATTERNS)), F.lit("promotion_or_advertisement")),
    )


def tokens_of(normalized: Column, min_chars: int = 2) -> Column:
    """Distinct lower-case tokens of an already normalized text."""
    words = F.array_distinct(F.split(F.lower(normalized), NOT_WORD))
    return F.filter(words, lambda w: F.char_length(w) >= min_chars)


def tokens(c: Column) -> Column:
    """H3: token set of a raw text, that of its normalized form.

    Of all that normalizing does only the folds of letters change a token:
    blanks, joiners and punctuation stand between tokens before and after.
    """
    return tokens_of(replaced(c, LETTER_FOLDS))


def set_overlap(a: Column, b: Column) -> Column:
    """H4/H7: shared share of the larger set; 0 when either is empty."""
    larger = F.greatest(F.size(a), F.size(b))
    either_empty = (F.size(a) <= 0) | (F.size(b) <= 0)
    return F.when(either_empty, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / larger)


def copy_score(a: Column, b: Column, proximity: Column) -> Column:
    """H5: lexical and temporal similarity of two token sets."""
    overlap = set_overlap(a, b)
    exact = F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (overlap == 1.0), F.lit(1)).otherwise(F.lit(0))
    return F.least(F.lit(1.0), exact * F.lit(0.2) + overlap * F.lit(0.7) + proximity * F.lit(0.1))


def _all_hits(c: Column, patterns) -> Column:
    return let(folded(c), lambda f: F.array_compact(F.array(*[F.when(matches(c, pattern, f), F.lit(key)) for key, pattern in patterns])))


def entity_keys(c: Column, patterns=ENTITY_PATTERNS) -> Column:
    """H6: keys of every entity pattern found, in table order."""
    return _all_hits(c, patterns)


def category_hints(c: Column, patterns=HINT_PATTERNS) -> Column:
    """H9: every category the text hints at."""
    return _all_hits(c, patterns)


def infer_category(c: Column, fallback: str = "IRAN", patterns=CATEGORY_PATTERNS) -> Column:
    """H8: first matching category."""
    return F.coalesce(let(folded(c), lambda f: first_hit(c, f, patterns)), F.lit(fallback))


def first_hit(c: Column, fold: Column, patterns) -> Column:
    """The name of the first pattern that matches, or null."""
    return F.coalesce(*[F.when(matches(c, pattern, fold), F.lit(name)) for name, pattern in patterns])


def refutes(c: Column) -> Column:
    """Does the text deny the report?"""
    return matches(c, REFUTATION_PATTERN)


def is_persian(c: Column) -> Column:
    """At least five Arabic-block letters, and at least as many as Latin ones."""
    persian = F.regexp_count(c, F.lit("[\u0600-\u06ff]"))
    latin = F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.coalesce((persian >= 5) & (persian >= latin), F.lit(False))


def has_persian(c: Column) -> Column:
    """H22, first half."""
    return F.coalesce(c.rlike("[\u0600-\u06ff]"), F.lit(False))


def has_latin(c: Column) -> Column:
    """H22, second half."""
    return F.coalesce(c.rlike("[A-Za-z]"), F.lit(False))


def cross_language(left: Column, right: Column) -> Column:
    return (has_persian(left) & has_latin(right)) | (has_latin(left) & has_persian(right))


def ellipsize(c: Column, n: int) -> Column:
    """Collapse blanks, then cut to ``n`` characters with an ellipsis."""
    return let(
        collapse_spaces(c),
        lambda flat: F.when(
            F.char_length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))
        ).otherwise(flat),
    )


def truncate_chars(c: Column, n: Column) -> Column:
    """Cut at a per-row code-point budget; an ellipsis marks the cut."""
    cut = F.concat(F.substr(c, F.lit(1), n - 1), F.lit("…"))
    return (
        F.when(F.char_length(c) <= n, c)
        .when(n <= 0, F.lit(""))
        .when(n == 1, F.lit("…"))
        .otherwise(cut)
    )


def redact(c: Column, secret: Column | None = None) -> Column:
    """Hide bearer tokens and one known key."""
    shown = F.coalesce(c, F.lit(""))
    if secret is not None:
        shown = F.when(F.coalesce(secret, F.lit("")) != "", F.replace(shown, secret, F.lit("[REDACTED]"))).otherwise(shown)
    return F.regexp_replace(shown, IGNORE_CASE + f"Bearer{SPACE}+[^{SPACES}\"']+", "Bearer [REDACTED]")


def parse_list(c: Column) -> Column:
    """Comma list to trimmed non-empty strings."""
    items = F.transform(F.split(F.coalesce(c, F.lit("")), ","), trim_spaces)
    return F.filter(items, lambda x: x != "")


def parse_id_list(c: Column) -> Column:
    """Comma list to positive integers."""
    numbers = F.transform(parse_list(c), lambda x: x.try_cast("bigint"))
    return F.filter(numbers, lambda x: x.isNotNull() & (x > 0))


def unique_positive_ids(ids: Column) -> Column:
    """Distinct positive ids in ascending order."""
    return F.sort_array(F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x > 0))))


def review_tokens(c: Column) -> Column:
    """Distinct tokens of three or more characters that are no stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), NOT_WORD)
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) >= 3) & ~F.array_contains(stop, w)))


def compact_report(
    post_id: Column,
    source_id: Column,
    source_name: Column,
    published_at: Column,
    observed_at: Column,
    normalized: Column,
    original: Column,
    chars: int = LIMITS.report_chars,
) -> Column:
    """The six fields of a report as JSON, text cut at ``chars``."""
    text = F.substring(first_non_empty(normalized, original), 1, chars)
    fields = F.struct(
        post_id.alias("post_id"),
        source_id.alias("source_id"),
        source_name.alias("source_name"),
        published_at.alias("published_at"),
        observed_at.alias("observed_at"),
        text.alias("text"),
    )
    return F.to_json(fields, {"ignoreNullFields": "false"})
