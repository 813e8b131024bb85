"""Story texts: fallback drafts, clean-up, captions and link rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corroborate.config import LIMITS
from corroborate.functions.text import SPACE, collapse_spaces, is_persian, let, trim_spaces, truncate_chars

# --- fixed values -----------------------------------------------------------
STATUS_LABELS = {
    "CONFIRMED": "تأییدشده",
    "DEVELOPING": "در حال تکمیل",
    "DISPUTED": "مورد اختلاف",
}
STATUS_LABEL_ELSE = "تأییدنشده"
STATUS_TITLE = "وضعیت"
CONFIRMATION_TITLE = "تأیید مستقل"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
CAMERA = "🎥"
RIGHT_TO_LEFT = "\u200f"
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
# ----------------------------------------------------------------------------


def status_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, status), F.lit(STATUS_LABEL_ELSE))


def fallback_title(fact: Column) -> Column:
    """The fact as a one-line title."""
    return let(
        collapse_spaces(fact),
        lambda flat: F.when(F.char_length(flat) <= 140, flat).otherwise(
            F.concat(F.substring(flat, 1, 137), F.lit("…"))
        ),
    )


def fallback_description(fact: Column, status: Column, confirmations: Column) -> Column:
    """The fact with a status line, cut at 1,000 characters."""
    text = F.concat(
        fact,
        F.lit(f"\n{STATUS_TITLE}: "),
        status_label(status),
        F.lit(f" | {CONFIRMATION_TITLE}: "),
        confirmations.cast("string"),
    )
    return F.substring(text, 1, 1000)


def story_is_persian(title: Column, description: Column) -> Column:
    """Both texts must read as Persian."""
    return is_persian(title) & is_persian(description)


def clean_line(c: Column) -> Column:
    """Drop a leading camera sign and user mentions."""
    text = F.regexp_replace(c, f"^{CAMERA}{SPACE}*", "")
    text = F.regexp_replace(text, f"(^|{SPACE})@[A-Za-z0-9_]{{3,}}", "$1")
    return trim_spaces(F.regexp_replace(text, "[ \t]{2,}", " "))


def clean_description(title: Column, description: Column) -> Column:
    """Drop a repeated title and status lines from a description."""
    status_line = f"^(?:{STATUS_TITLE}|{CONFIRMATION_TITLE}){SPACE}*[:：]"
    given = trim_spaces(F.regexp_replace(title, "\r\n?", ""))
    shown = clean_line(title)

    def without_title(t: Column) -> Column:
        text, given, shown = t["text"], t["given"], t["shown"]
        flat_text = F.regexp_replace(text, f"{SPACE}+", " ")
        return (
            F.when(F.startswith(text, given), trim_spaces(F.substr(text, F.char_length(given) + 1)))
            .when(F.startswith(flat_text, collapse_spaces(shown)), trim_spaces(F.substr(text, F.char_length(shown) + 1)))
            .otherwise(text)
        )

    parts = F.struct(
        trim_spaces(F.regexp_replace(description, "\r\n?", "\n")).alias("text"), given.alias("given"), shown.alias("shown")
    )
    kept = F.filter(F.split(let(parts, without_title), "\n"), lambda line: ~trim_spaces(line).rlike(status_line))
    return clean_line(trim_spaces(F.array_join(kept, "\n")))


def escape_html(c: Column) -> Column:
    for plain, escaped in HTML_ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def persian_digits(n: Column) -> Column:
    return F.translate(n.cast("string"), "0123456789", PERSIAN_DIGITS)


def render_caption(
    title: Column,
    description: Column,
    status: Column,
    confirmations: Column,
    tags: Column,
    max_chars: int = LIMITS.caption_chars,
) -> Column:
    """The publication text; the description gets what is left of the budget."""
    status_line = F.concat(F.lit(f"{STATUS_TITLE}: "), status_label(status))
    confirmation_line = F.concat(F.lit(f"{CONFIRMATION_TITLE}: "), persian_digits(confirmations))
    hashtags = F.array_join(
        F.transform(tags, lambda t: F.concat(F.lit("#"), F.regexp_replace(t, f"{SPACE}+", "_"))), " "
    )

    def sections(t: Column) -> Column:
        fixed = F.filter(F.array(t["head"], t["status"], t["confirmed"], t["tags"]), lambda s: s != "")
        used = F.aggregate(fixed, F.lit(0), lambda acc, s: acc + F.char_length(s)) + 2 * F.size(fixed)
        budget = F.greatest(F.lit(0), F.lit(max_chars) - used)
        lines = F.array(
            F.concat(F.lit("<b>"), escape_html(t["head"]), F.lit("</b>")),
            F.nullif(escape_html(truncate_chars(t["body"], budget)), F.lit("")),
            t["status"],
            t["confirmed"],
            F.nullif(escape_html(t["tags"]), F.lit("")),
        )
        return F.concat(F.lit(RIGHT_TO_LEFT), F.array_join(lines, "\n\n"))

    parts = F.struct(
        clean_line(title).alias("head"),
        clean_description(title, description).alias("body"),
        status_line.alias("status"),
        confirmation_line.alias("confirmed"),
        hashtags.alias("tags"),
    )
    return let(parts, sections)


def link_rows(links: Column, label_chars: int = 32) -> Column:
    """Links distinct by url in first-seen order, two to a row."""
    urls = F.transform(links, lambda link: link["url"])
    distinct = F.filter(links, lambda link, i: F.array_position(urls, link["url"]) == i + 1)
    shown = F.transform(
        distinct,
        lambda link: F.struct(F.substring(link["label"], 1, label_chars).alias("text"), link["url"].alias("url")),
    )
    starts = F.when(F.size(shown) > 0, F.sequence(F.lit(1), F.size(shown), F.lit(2))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda at: F.slice(shown, at, 2))
