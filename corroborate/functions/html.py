"""Message page functions: text blocks, entities and field captures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corroborate.functions.text import first_non_empty, let, matches, trim_spaces

# --- fixed values -----------------------------------------------------------
# Markers of the landed page format.
MARKER = r'data-post="[^"]+/[0-9]+"'
WIDGET = "tgme_page_widget"
TEXT_BLOCK = r'class="[^"]*tgme_widget_message_text[^"]*"[^>]*>([\s\S]*?)</div>'
TIME_TAG = r'<time[^>]*datetime="([^"]+)"'
FORWARD_CLASS = r'class="[^"]*tgme_widget_message_forwarded_from[^"]*"[^>]*href="https://t\.me/([^/?"#]+)[^"]*"'
FORWARD_NEAR = r'tgme_widget_message_forwarded_from[\s\S]{0,800}?href="https://t\.me/([^/?"#]+)[^"]*"'
EDITED = "(?<![A-Za-z0-9_])edited(?![A-Za-z0-9_])|ویرایش"
MEDIA_MARKERS = (
    ("photo", "tgme_widget_message_photo_wrap"),
    ("video", "tgme_widget_message_video"),
    ("document", "tgme_widget_message_document"),
)
URL_PREFIX = "https://t.me/"
NO_MARKERS = "page_has_no_message_markers"
FOREIGN_PAGE = "not_a_telegram_public_page"
# Named entities, decoded in this order before the numeric ones.
ENTITIES = (
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&quot;", '"'),
    ("&#39;|&apos;", "'"),
    ("(?i)&#x27;", "'"),
    ("(?i)&#x2F;", "/"),
)
# ----------------------------------------------------------------------------


def capture(c: Column, pattern: str) -> Column:
    """First group of a case-blind match, null when there is none or it is empty."""
    return first_non_empty(F.regexp_extract(c, "(?i)" + pattern, 1))


def decode_numeric_entities(c: Column) -> Column:
    """Replace ``&#NNNN;`` by the code point, whatever its plane.

    The text is cut before each entity; a piece that starts with one becomes
    the decoded character plus the rest. UTF-32 decoding turns the number into
    a character without leaving the JVM.
    """
    lead = "^&#([0-9]+);"

    def decoded(piece: Column) -> Column:
        number = F.regexp_extract(piece, lead, 1).try_cast("bigint")
        code = F.unhex(F.lpad(F.hex(number), 8, "0"))
        known = piece.rlike(lead) & (number <= 0x10FFFF)
        return F.when(known, F.concat(F.decode(code, "UTF-32"), F.regexp_replace(piece, lead, ""))).otherwise(piece)

    def joined(text: Column) -> Column:
        pieces = F.transform(F.split(text, "(?=&#[0-9]+;)"), decoded)
        return F.when(text.contains("&#"), F.array_join(pieces, "")).otherwise(text)

    return let(c, joined)


def html_text(c: Column) -> Column:
    """The text of an HTML fragment."""
    text = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, "<[^>]+>", "")
    for pattern, plain in ENTITIES:
        text = F.regexp_replace(text, pattern, plain)
    return trim_spaces(decode_numeric_entities(text))


def forwarded_from(segment: Column) -> Column:
    """The channel a message was forwarded from."""
    return F.coalesce(capture(segment, FORWARD_CLASS), capture(segment, FORWARD_NEAR))


def message_text(segment: Column) -> Column:
    """Decoded text block, empty when the message has none."""
    return html_text(F.coalesce(capture(segment, TEXT_BLOCK), F.lit("")))


def message_time(segment: Column) -> Column:
    return capture(segment, TIME_TAG).try_cast("timestamp")


def is_edited(segment: Column) -> Column:
    return matches(segment, EDITED)


def media_type(segment: Column) -> Column:
    ladder = None
    for name, marker in MEDIA_MARKERS:
        hit = segment.contains(marker)
        ladder = F.when(hit, F.lit(name)) if ladder is None else ladder.when(hit, F.lit(name))
    return ladder


def content_hash(url: Column, text: Column, media: Column) -> Column:
    """Fingerprint of what a reader would see."""
    parts = F.concat(url, F.lit("\n"), text, F.lit("\n"), F.coalesce(media, F.lit("")))
    return F.sha2(parts, 256)


def page_warning(html: Column) -> Column:
    """A3: why a page holds no messages, or null."""
    return F.when(
        ~F.coalesce(html.rlike(MARKER), F.lit(False)),
        F.when(html.contains(WIDGET), F.lit(NO_MARKERS)).otherwise(F.lit(FOREIGN_PAGE)),
    )


def bounded_html(html: Column, max_bytes: int) -> Column:
    """A1: cap a page in bytes; a character cut in half becomes U+FFFD."""
    raw = F.encode(html, "UTF-8")
    return F.when(
        F.octet_length(html) > max_bytes,
        F.make_valid_utf8(F.substring(raw, 1, max_bytes).cast("string")),
    ).otherwise(html)
