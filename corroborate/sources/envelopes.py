"""Contract check of ingest envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.config import LIMITS, TRANSPORT, UPDATE_TYPES

# --- fixed values -----------------------------------------------------------
ISO_WITH_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"
HASH = "^[a-f0-9]{64}$"
URL = r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"
MAX_TEXT = 200_000
MAX_MEDIA = 64
# ----------------------------------------------------------------------------


def _iso(c: Column) -> Column:
    return c.rlike(ISO_WITH_OFFSET) & c.try_cast("timestamp").isNotNull()


def envelope_rules() -> dict[str, Column]:
    """Reason code -> condition that must hold. Null counts as broken."""
    c = F.col
    return {
        "schema_version": c("schema_version") == 1,
        "transport": c("transport") == TRANSPORT,
        "source_id": c("source_id") > 0,
        "source_key": F.char_length("source_key") >= 1,
        "external_message_id": c("external_message_id") > 0,
        "update_type": c("update_type").isin(*UPDATE_TYPES),
        "observed_at": _iso(c("observed_at")),
        "post.source_id": c("post.source_id") > 0,
        "post.source_key": F.char_length("post.source_key") >= 1,
        "post.username": F.char_length("post.username") >= 1,
        "post.message_id": c("post.message_id") > 0,
        "post.canonical_url": c("post.canonical_url").rlike(URL),
        "post.published_at": c("post.published_at").isNull() | _iso(c("post.published_at")),
        "post.edited_at": c("post.edited_at").isNull() | _iso(c("post.edited_at")),
        "post.text": F.char_length("post.text") <= MAX_TEXT,
        "post.media_type": c("post.media_type").isNull() | (F.char_length("post.media_type") <= MAX_MEDIA),
        "post.content_hash": c("post.content_hash").rlike(HASH),
        "post.raw_html_snippet": F.char_length("post.raw_html_snippet") <= LIMITS.snippet_chars,
        "post.metadata": F.try_parse_json("post.metadata").isNotNull()
        & F.schema_of_variant(F.try_parse_json("post.metadata")).startswith("OBJECT"),
    }


def check_envelopes(envelopes: DataFrame) -> DataFrame:
    """The envelopes with the array of broken rules."""
    broken = [
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in envelope_rules().items()
    ]
    return envelopes.withColumn("reasons", F.array_compact(F.array(*broken)))


def validate_envelopes(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reasons)."""
    checked = check_envelopes(envelopes)
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)
