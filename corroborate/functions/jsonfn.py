"""JSON functions over columns, built on VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corroborate.functions.text import IGNORE_CASE, SPACE, let, trim_spaces

FENCE_OPEN = f"{IGNORE_CASE}^{SPACE}*```(?:json)?{SPACE}*"
FENCE_CLOSE = f"{SPACE}*```{SPACE}*$"


def parse_object(c: Column) -> Column:
    """VARIANT of a text that is exactly one JSON object, else null.

    The text is parsed inside brackets: text after the object then breaks the
    parse, or shows up as a second element.
    """

    def only_object(wrapped: Column) -> Column:
        first = F.try_variant_get(wrapped, "$[0]", "variant")
        second = F.try_variant_get(wrapped, "$[1]", "variant")
        return F.when(second.isNull() & is_object(first), first)

    return let(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), only_object)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def object_at(v: Column, path: str) -> Column:
    found = at(v, path)
    return F.when(is_object(found), found)


def string_at(v: Column, path: str) -> Column:
    return F.when(is_string(at(v, path)), F.try_variant_get(v, path, "string"))


def meta_string(metadata: Column, key: str) -> Column:
    """A string member of the metadata object; anything else is missing."""
    return string_at(parse_object(metadata), f"$.{key}")


def meta_truthy(metadata: Column, key: str) -> Column:
    """Is the member present and neither empty, zero, false nor null?"""
    value = F.try_variant_get(parse_object(metadata), f"$.{key}", "string")
    return F.coalesce(~value.isin("", "0", "false"), F.lit(False))


def json_from_text(c: Column) -> Column:
    """The JSON object in a text, code fences and prose around it allowed."""
    cleaned = trim_spaces(F.regexp_replace(F.regexp_replace(c, FENCE_OPEN, ""), FENCE_CLOSE, ""))
    span = F.nullif(F.regexp_extract(cleaned, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(parse_object(cleaned), parse_object(span))


def unwrap_response(body: Column) -> Column:
    """The JSON object a model answered with, as text."""
    return F.to_json(let(parse_object(body), _answer))


def _answer(v: Column) -> Column:
    result = object_at(v, "$.result")
    content = F.when(
        is_object(at(v, "$.choices[0]")) & is_object(at(v, "$.choices[0].message")),
        at(v, "$.choices[0].message.content"),
    )
    content_text = F.when(is_string(content), F.try_variant_get(content, "$", "string"))
    parts = F.from_json(F.to_json(content), "array<variant>")
    texts = F.transform(F.filter(parts, is_object), lambda p: F.coalesce(string_at(p, "$.text"), F.lit("")))
    joined = F.nullif(F.array_join(texts, ""), F.lit(""))
    fallback = F.coalesce(string_at(v, "$.response"), string_at(v, "$.result"))
    return (
        F.when(is_object(at(v, "$.response")), at(v, "$.response"))
        .when(result.isNotNull(), F.coalesce(object_at(result, "$.response"), result))
        .when(is_object(content), content)
        .when(content_text.isNotNull(), json_from_text(content_text))
        .when(joined.isNotNull(), json_from_text(joined))
        .otherwise(json_from_text(F.nullif(fallback, F.lit(""))))
    )


def usage_tokens(body: Column, key: str) -> Column:
    """A usage counter, 0 when it is missing or no number."""
    v = at(parse_object(body), f"$.usage.{key}")
    numeric = F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL)")
    return F.coalesce(F.when(numeric, F.try_variant_get(v, "$", "double")), F.lit(0.0))


def finish_reasons(body: Column) -> Column:
    """Finish reason of every choice, null where it is no string."""
    choices = F.from_json(F.to_json(at(parse_object(body), "$.choices")), "array<variant>")
    return F.coalesce(
        F.transform(choices, lambda c: string_at(c, "$.finish_reason")),
        F.array().cast("array<string>"),
    )


def split_route(route: Column) -> tuple[Column, Column]:
    """``provider/model`` at the first slash."""
    trimmed = F.nullif(trim_spaces(route), F.lit(""))
    slash = F.locate("/", trimmed)
    provider = F.nullif(F.when(slash > 0, F.substr(trimmed, F.lit(1), slash - 1)).otherwise(trimmed), F.lit(""))
    model = F.nullif(F.when(slash > 0, F.substr(trimmed, slash + 1)), F.lit(""))
    return provider, model


def _first_text(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.nullif(trim_spaces(string_at(v, p)), F.lit("")) for p in paths])


ATTEMPTS = "array<variant>"


def gateway_attempts(body: Column) -> Column:
    """The upstream attempts listed in a gateway error, in one shape."""
    items = F.from_json(F.to_json(at(parse_object(body), "$.error.attempts")), ATTEMPTS)

    def one(v: Column) -> Column:
        provider, model = split_route(_first_text(v, "$.routed_via", "$.route", "$.routedVia"))
        return F.struct(
            F.coalesce(_first_text(v, "$.provider", "$.provider_name"), provider).alias("provider"),
            F.coalesce(_first_text(v, "$.model", "$.routed_model", "$.model_name"), model).alias("model"),
            F.try_variant_get(v, "$.status", "int").alias("status"),
            _first_text(v, "$.error_code", "$.code", "$.error.code", "$.error.error_code").alias("error_code"),
            _first_text(v, "$.error_message", "$.message", "$.error.message", "$.error.error_message").alias(
                "error_message"
            ),
        )

    empty = F.array().cast(
        "array<struct<provider:string,model:string,status:int,error_code:string,error_message:string>>"
    )
    return F.coalesce(F.transform(items, one), empty)


def gateway_error(body: Column) -> Column:
    """Code and message of a gateway error."""
    v = at(parse_object(body), "$.error")
    return F.struct(
        _first_text(v, "$.code", "$.error_code").alias("error_code"),
        _first_text(v, "$.message", "$.error_message").alias("error_message"),
    )


def failure_class(
    status: Column, code: Column, has_output: Column, schema_valid: Column, validation_error: Column
) -> Column:
    """Why a logged call failed, null when it did not."""
    c = F.lower(F.coalesce(code, F.lit("")))

    def has(*needles: str) -> Column:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | c.contains(needle)
        return hit

    s = F.coalesce(status, F.lit(-1))
    ok = (s >= 200) & (s < 300)
    return (
        F.when(has("structured_json_invalid", "json_invalid"), F.lit("structured_json_invalid"))
        .when(has("structured_schema_invalid", "schema_invalid"), F.lit("structured_schema_invalid"))
        .when(has("timeout"), F.lit("upstream_timeout"))
        .when((s == 429) | (c == "429") | has("rate_limit"), F.lit("429"))
        .when(s.isin(401, 403) | has("auth"), F.lit("auth"))
        .when(has("model_unavailable", "model-unavailable"), F.lit("model_unavailable"))
        .when(has("provider_error", "provider-error"), F.lit("provider_error"))
        .when((s >= 500) & (s <= 599), F.lit("provider_5xx"))
        .when(ok & ~has_output, F.lit("structured_json_invalid"))
        .when(ok & ~schema_valid, F.lit("structured_schema_invalid"))
        .when(validation_error, F.lit("structured_schema_invalid"))
        .when((s != 200) & status.isNotNull(), F.lit("other"))
    )


def benchmark_failure(
    status: Column,
    transport_error: Column,
    error_text: Column,
    truncated: Column,
    has_output: Column,
    schema_valid: Column,
    contract_valid: Column,
    first_code: Column,
) -> Column:
    """Failure ladder of the model benchmark, null for a valid answer."""
    ok = (status >= 200) & (status < 300)
    timed_out = status.isin(408, 504) | F.coalesce(error_text, F.lit("")).contains("upstream_timeout")
    named = F.upper(first_code)
    known = named.isin(
        "MISSING_POST_COVERAGE",
        "DUPLICATE_POST_ASSIGNMENT",
        "INVALID_EVENT_REFERENCE",
        "INVALID_DUPLICATE_REFERENCE",
        "ACTION_REFERENCE_MISMATCH",
    )
    return (
        F.when(transport_error | status.isNull(), F.lit("HTTP_FAILURE"))
        .when(~ok & timed_out, F.lit("TIMEOUT"))
        .when(~ok, F.lit("HTTP_FAILURE"))
        .when(truncated, F.lit("TRUNCATED"))
        .when(~has_output, F.lit("INVALID_JSON"))
        .when(~schema_valid, F.lit("SCHEMA_INVALID"))
        .when(~contract_valid, F.lit("ZOD_INVALID"))
        .when(known, named)
        .when(first_code.isNotNull(), F.lit("OTHER"))
    )
