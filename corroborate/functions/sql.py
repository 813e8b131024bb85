"""SQL-callable versions of the text and time functions.

``register`` creates temporary SQL functions. All but ``normalize_place`` are
plain SQL bodies, which Catalyst inlines into the calling query.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from corroborate.functions import places
from corroborate.functions import text as T


def _q(s: str) -> str:
    """A raw string literal; none of the patterns holds both quote signs."""
    return f'r"{s}"' if "'" in s else f"r'{s}'"


def _matches(arg: str, pattern: str) -> str:
    return f"coalesce({arg} rlike {_q(T.IGNORE_CASE + pattern)}, false)"


def _hits(arg: str, patterns) -> str:
    items = ", ".join(f"CASE WHEN {_matches(arg, p)} THEN '{name}' END" for name, p in patterns)
    return f"array_compact(array({items}))"


def definitions() -> dict[str, str]:
    """Signature -> SQL body of every function."""
    blanks = f"regexp_replace(translate(t, {_q(T.FOLD_FROM)}, {_q(T.FOLD_TO)}), '[\t\r\n ]+', ' ')"
    closed = f"regexp_replace({blanks}, {_q(f'{T.SPACE}+([{T.PUNCTUATION}])')}, '$1')"
    normal = f"regexp_replace({closed}, {_q(f'^{T.SPACE}+|{T.SPACE}+$')}, '')"
    ladder = " ".join(f"WHEN {_matches('t', p)} THEN '{name}'" for name, p in T.CATEGORY_PATTERNS)
    words = f"array_distinct(filter(split(lower(normalize_text(t)), {_q(T.NOT_WORD)}), w -> char_length(w) >= 2))"
    shared = "size(array_intersect(a, b)) / greatest(size(a), size(b))"
    return {
        "normalize_text(t STRING) RETURNS STRING": normal,
        "noise_reason(t STRING) RETURNS STRING": (
            f"CASE WHEN coalesce(t, '') = '' THEN 'empty' WHEN char_length(t) < {T.MIN_TEXT_CHARS} THEN 'too_short' "
            f"WHEN {_matches('t', '|'.join(T.NOISE_PATTERNS))} THEN 'promotion_or_advertisement' END"
        ),
        "token_set(t STRING) RETURNS ARRAY<STRING>": words,
        "set_overlap(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": (
            f"CASE WHEN size(a) <= 0 OR size(b) <= 0 THEN 0.0D ELSE {shared} END"
        ),
        "token_overlap(a STRING, b STRING) RETURNS DOUBLE": "set_overlap(token_set(a), token_set(b))",
        "entity_keys(t STRING) RETURNS ARRAY<STRING>": _hits("t", T.ENTITY_PATTERNS),
        "category_hints(t STRING) RETURNS ARRAY<STRING>": _hits("t", T.HINT_PATTERNS),
        "infer_category(t STRING) RETURNS STRING": f"CASE {ladder} ELSE 'IRAN' END",
        "refutes(t STRING) RETURNS BOOLEAN": _matches("t", T.REFUTATION_PATTERN),
        "time_proximity(a TIMESTAMP, b TIMESTAMP) RETURNS DOUBLE": (
            "coalesce(greatest(0.0D, 1.0D - abs(unix_micros(a) - unix_micros(b)) / 172800000000.0D), 0.0D)"
        ),
        "clamp_score(x DOUBLE) RETURNS BIGINT": "least(100, greatest(0, floor(x + 0.5D)))",
    }


def register(spark: SparkSession) -> list[str]:
    """K3: make the functions callable from SQL; returns their names."""
    names = []
    for signature, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
        names.append(signature.split("(")[0])
    spark.udf.register("nfkc", places.nfkc)
    return [*names, "nfkc"]
