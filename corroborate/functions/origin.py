"""Where a report comes from: cited outlets, origin names, groups and types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corroborate.functions.jsonfn import meta_string, meta_truthy
from corroborate.functions.text import SPACE, SPACES, first_hit, first_non_empty, folded, let, matches, trim_spaces

_WORD = "[A-Za-z0-9_]"


def _latin_word(word: str) -> str:
    """The word with ASCII boundaries."""
    return f"(?<!{_WORD}){word}(?!{_WORD})"


def _glued(word: str) -> str:
    """A non-ASCII word between ASCII word characters.

    An ASCII ``\\b`` next to a Persian letter holds only there, so the bare
    Persian agency names practically never count as citations.
    """
    return f"(?<={_WORD}){word}(?={_WORD})"


# --- fixed values -----------------------------------------------------------
# Outlets that can be cited; the first match wins.
CITED_PATTERNS = (
    ("reuters", "رویترز|reuters"),
    ("ap", f"آسوشیتد{SPACE}*پرس|associated press|" + _latin_word("AP")),
    ("afp", f"فرانس{SPACE}*پرس|agence france-presse|" + _latin_word("AFP")),
    ("irna", "خبرگزاری جمهوری اسلامی|" + _glued("ایرنا") + "|" + _latin_word("IRNA")),
    ("tasnim", "خبرگزاری تسنیم|" + _glued("تسنیم") + "|" + _latin_word("Tasnim")),
    ("fars", "خبرگزاری فارس|" + _glued("فارس") + "|Fars News"),
    ("bbc_persian", f"بی[\u200c{SPACES}-]*بی[\u200c{SPACES}-]*سی فارسی|BBC Persian"),
    ("iran_international", "ایران اینترنشنال|Iran International"),
    ("euronews", "یورونیوز|Euronews"),
    ("alarabiya", "العربیه|Al Arabiya"),
)
# A citation counts only next to an attribution phrase.
ATTRIBUTION = (
    f"به{SPACE}+(?:نقل|گزارش){SPACE}+از|منبع{SPACE}*[:：]|according to|"
    f"reports?{SPACE}+(?:from|by)|via"
)
# Spellings of the known origins.
ORIGIN_ALIASES = (
    ("رویترز", "reuters"),
    ("reuters", "reuters"),
    ("آسوشیتد_پرس", "ap"),
    ("associated_press", "ap"),
    ("ap", "ap"),
    ("فرانس_پرس", "afp"),
    ("afp", "afp"),
    ("ایرنا", "irna"),
    ("irna", "irna"),
    ("irna_1313", "irna"),
    ("تسنیم", "tasnim"),
    ("tasnim", "tasnim"),
    ("tasnimnews", "tasnim"),
    ("فارس", "fars"),
    ("fars", "fars"),
    ("farsna", "fars"),
    ("bbc_persian", "bbc_persian"),
    ("bbcpersian", "bbc_persian"),
    ("iran_international", "iran_international"),
    ("iranintltv", "iran_international"),
)
ORIGIN_CHARS = 80
# ----------------------------------------------------------------------------


def cited_source(text: Column) -> Column:
    """The outlet a text attributes its report to."""
    return let(folded(text), lambda f: F.when(matches(text, ATTRIBUTION, f), first_hit(text, f, CITED_PATTERNS)))


def fold_origin(c: Column) -> Column:
    """H15 + C12: canonical origin name; unknown names are folded and cut."""
    folded = F.regexp_replace(
        F.regexp_replace(F.lower(trim_spaces(c)), "^@", ""), f"[{SPACES}_-]+", "_"
    )
    aliases = F.create_map(*[F.lit(x) for pair in ORIGIN_ALIASES for x in pair])
    return F.coalesce(F.try_element_at(aliases, folded), F.substring(folded, 1, ORIGIN_CHARS))


#: Roles of channels that pass on reports of others.
AGGREGATING = ("aggregator", "early_alert")


def own_origin(metadata: Column) -> Column:
    """The origin a post declares itself, forwarded before cited; null if none."""
    forwarded = first_non_empty(fold_origin(meta_string(metadata, "forwarded_from")))
    cited = first_non_empty(fold_origin(meta_string(metadata, "cited_source")))
    return F.concat(F.lit("origin:"), F.coalesce(forwarded, cited))


def default_origin(is_wire: Column, source_key: Column, source_id: Column) -> Column:
    return F.when(is_wire, F.concat(F.lit("origin:"), source_key)).otherwise(
        F.concat(F.lit("source:"), source_id.cast("string"))
    )


def origin_group(
    metadata: Column,
    is_wire: Column,
    source_key: Column,
    source_id: Column,
    copied_group: Column | None = None,
) -> Column:
    """Forwarded, then cited, then copied, then the source itself."""
    choices = [own_origin(metadata)]
    if copied_group is not None:
        choices.append(first_non_empty(copied_group))
    return F.coalesce(*choices, default_origin(is_wire, source_key, source_id))


def origin_type(metadata: Column, is_wire: Column, role: Column, aggregating: tuple[str, ...] = AGGREGATING) -> Column:
    """How the report reached the channel. Channels of an ``aggregating`` role pass on what others report."""
    return (
        F.when(meta_truthy(metadata, "forwarded_from"), F.lit("forward_repost"))
        .when(meta_string(metadata, "cited_source").isNotNull(), F.lit("wire_republish"))
        .when(is_wire | (role == "primary_source"), F.lit("original_reporting"))
        .when(role.isin(*aggregating), F.lit("aggregation"))
        .otherwise(F.lit("unknown"))
    )


def relationship_confidence(copied: Column, kind: Column) -> Column:
    """Copied .9, unknown origin .55, anything else .8."""
    return F.when(copied, F.lit(0.9)).when(kind == "unknown", F.lit(0.55)).otherwise(F.lit(0.8))
