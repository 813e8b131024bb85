"""Importance scores as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corroborate.config import LIMITS

# --- fixed values -----------------------------------------------------------
# Weights of the six subscores, in summing order.
WEIGHTS = (
    ("impact", 0.25),
    ("iran_relevance", 0.25),
    ("urgency", 0.15),
    ("confidence", 0.15),
    ("novelty", 0.1),
    ("geopolitical", 0.1),
)
CATEGORY_IMPACT = {
    "WAR_SECURITY": 25,
    "POLITICS": 18,
    "ECONOMY": 18,
    "SOCIETY": 18,
    "WORLD": 15,
    "TECHNOLOGY": 12,
}
CATEGORY_IMPACT_ELSE = 10
CATEGORY_IRAN = {
    "IRAN": 92,
    "POLITICS": 82,
    "WAR_SECURITY": 82,
    "ECONOMY": 72,
    "SOCIETY": 72,
    "TECHNOLOGY": 48,
    "WORLD": 42,
}
CATEGORY_IRAN_ELSE = 45
CATEGORY_GEOPOLITICAL = {
    "WAR_SECURITY": 72,
    "POLITICS": 55,
    "WORLD": 55,
    "ECONOMY": 38,
    "SOCIETY": 28,
    "TECHNOLOGY": 24,
}
CATEGORY_GEOPOLITICAL_ELSE = 22
# ----------------------------------------------------------------------------


def by_category(category: Column, table: dict[str, int], otherwise: int) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, category), F.lit(otherwise))


def clamp(x: Column) -> Column:
    """Round half up into 0..100."""
    rounded = F.floor(x.cast("double") + F.lit(0.5)).cast("bigint")
    return F.least(F.lit(100).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), rounded))


def band(score: Column) -> Column:
    return (
        F.when(score >= LIMITS.breaking_score, F.lit("BREAKING"))
        .when(score >= LIMITS.publish_score, F.lit("CANDIDATE"))
        .when(score >= LIMITS.monitor_score, F.lit("MONITOR"))
        .otherwise(F.lit("IGNORE"))
    )


def status_confidence(status: Column, confirmations: Column) -> Column:
    return (
        F.when(status == "CONFIRMED", clamp(72 + confirmations * 7))
        .when(status == "DEVELOPING", clamp(42 + confirmations * 9))
        .when(status == "DISPUTED", F.lit(24).cast("bigint"))
        .otherwise(F.lit(8).cast("bigint"))
    )


def subscores(
    category: Column, status: Column, confirmations: Column, hours: Column, state: Column
) -> dict[str, Column]:
    """The six subscores by name."""
    active = F.when(state == "active", F.lit(5)).otherwise(F.lit(0))
    return {
        "impact": clamp(
            20
            + F.least(confirmations, F.lit(3)) * 8
            + by_category(category, CATEGORY_IMPACT, CATEGORY_IMPACT_ELSE)
        ),
        "iran_relevance": by_category(category, CATEGORY_IRAN, CATEGORY_IRAN_ELSE).cast("bigint"),
        "urgency": clamp(F.lit(95.0) - hours * F.lit(9.0) + active),
        "confidence": status_confidence(status, confirmations),
        "novelty": F.when(hours <= 2, F.lit(82))
        .when(hours <= 6, F.lit(68))
        .when(hours <= 24, F.lit(48))
        .otherwise(F.lit(25))
        .cast("bigint"),
        "geopolitical": by_category(
            category, CATEGORY_GEOPOLITICAL, CATEGORY_GEOPOLITICAL_ELSE
        ).cast("bigint"),
    }


def weighted_score(parts: dict[str, Column]) -> Column:
    """Weighted sum, left to right in double, rounded half up."""
    total = None
    for name, weight in WEIGHTS:
        term = parts[name].cast("double") * F.lit(weight)
        total = term if total is None else total + term
    return F.floor(total + F.lit(0.5)).cast("bigint")


def adjust(score: Column, delta: Column) -> Column:
    """Move a score and keep it in range."""
    return clamp(score + delta)
