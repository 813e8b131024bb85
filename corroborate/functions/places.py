"""Explicit places of a report and contradictions between two reports."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from corroborate.functions.text import let


@dataclass(frozen=True)
class Place:
    node: str
    level: str
    parent: str | None
    aliases: tuple[str, ...]


# --- fixed values -----------------------------------------------------------
# The place tree; aliases are already normalized.
PLACES = (
    Place("iran", "country", None, ("ایران", "iran")),
    Place("tehran", "city", "iran", ("تهران", "طهران", "tehran")),
    Place("amol", "city", "iran", ("آمل", "آملی ها", "amol")),
    Place("mashhad", "city", "iran", ("مشهد", "mashhad")),
    Place(
        "sadeghieh",
        "district",
        "tehran",
        (
            "فلکه دوم صادقیه",
            "صادقیه",
            "sadeghieh",
            "sadeghiyeh",
            "sadeghieh square",
            "second sadeghieh square",
        ),
    ),
)
FOLD_FROM = "\u064a\u0649\u0643\u06c0\u0629"
FOLD_TO = "\u06cc\u06cc\u06a9\u0647\u0647"
DROPPED = "[\u0640\u064b-\u065f\u0670]"
JOINERS = "[\u200c\u200d]"
# ----------------------------------------------------------------------------


@pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in for it."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalize_place(c: Column) -> Column:
    """The form place names are compared in."""
    folded = F.translate(nfkc(c), FOLD_FROM, FOLD_TO)
    plain = F.regexp_replace(F.regexp_replace(folded, DROPPED, ""), JOINERS, " ")
    return F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]+", " "))


def ancestors(places=PLACES) -> dict[str, list[str]]:
    """Every node with itself and all nodes above it."""
    parent = {p.node: p.parent for p in places}
    chains = {}
    for node in parent:
        chain, at = [], node
        while at is not None and at not in chain:
            chain.append(at)
            at = parent.get(at)
        chains[node] = chain
    return chains


def _chain_map(places, drop_self: bool) -> Column:
    pairs = []
    for node, chain in ancestors(places).items():
        kept = chain[1:] if drop_self else chain
        pairs += [F.lit(node), F.array(*[F.lit(x) for x in kept]).cast("array<string>")]
    return F.create_map(*pairs)


def places_in(normalized: Column, places=PLACES) -> Column:
    """H20 on a text already in place form: most specific places named in it."""
    above = _chain_map(places, drop_self=True)

    def named(padded: Column) -> Column:
        hits = []
        for place in places:
            hit = F.lit(False)
            for alias in place.aliases:
                hit = hit | padded.contains(f" {alias} ")
            hits.append(F.when(hit, F.lit(place.node)))
        return F.array_compact(F.array(*hits))

    found = let(F.concat(F.lit(" "), normalized, F.lit(" ")), named)
    return let(found, lambda f: F.array_except(f, F.flatten(F.transform(f, lambda n: above[n]))))


def explicit_places(c: Column, places=PLACES) -> Column:
    """Most specific places named in a text."""
    return places_in(normalize_place(c), places)


def places_contradict(left: Column, right: Column, places=PLACES) -> Column:
    """Both sides name places and none of them contains another."""
    chain = _chain_map(places, drop_self=False)
    left_up = F.flatten(F.transform(left, lambda n: chain[n]))
    right_up = F.flatten(F.transform(right, lambda n: chain[n]))
    related = F.arrays_overlap(left, right_up) | F.arrays_overlap(left_up, right)
    return F.coalesce((F.size(left) > 0) & (F.size(right) > 0) & ~related, F.lit(False))


def place_closure(spark: SparkSession, places=PLACES) -> DataFrame:
    """(place, within) for every place and each place that contains it.

    The gazetteer is a parameter of a few rows, so its closure is a constant
    relation that Spark plans as a local table.
    """
    rows = [(node, above) for node, chain in ancestors(places).items() for above in chain]
    return spark.createDataFrame(rows, "place string, within string")
