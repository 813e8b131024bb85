"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document gets the key -ln(u) / w: u is uniform and follows from the
document's id and the seed, w is its quality weight. Ascending keys are a
weighted order without replacement. A source's target in words is met by
complete epochs of the whole source first, and then by the documents of
smallest keys until the rest of the target is used up. The last of these is
cut at the target, so the words taken equal the target but for its fraction.

Scale: a prefix sum over a source would put the source into one task. Each
source is therefore cut into blocks at quantiles of its keys; rows are sorted
inside (source, block), and only one row for each block takes part in the
window over the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.llm.common import TOKEN, fresh_names, without
from corroborate.session import cut_lineage

#: Result columns.
ADDED = ("size", "source_size", "target", "taken")
#: Largest table of sources (with their key quantiles) that is sent to every executor; beyond it the join shuffles.
MAX_BROADCAST_BYTES = 8 << 20
_HEX = 13  # hexadecimal digits of the hash that make u


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def text_weight(text: Column) -> Column:
    """Quality weight in [0.25, 1]: 1 less three quarters of the share of symbols in the text."""
    length = F.greatest(F.length(text), F.lit(1))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(F.lit(1.0) - F.lit(0.75) * symbols / length, F.lit(1.0))


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that follows from ``key`` (null: empty) and ``seed``."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("double") + 0.5) / float(16**_HEX)


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most_epochs: int = 3, share: float = 1.0
) -> DataFrame:
    """Targets in words from one row (source, source_size) for each source.

    Sources in code point order, null last, have the given weights in turn and
    share ``share`` of all words by weight. No target exceeds ``most_epochs``
    times its source's size; the excess is shared anew by weight. That is the
    level L at which the sum of min(most_epochs * size, L * weight) is the
    total: sources are capped in ascending order of cap / weight.
    """
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = [F.col("source").asc_nulls_last()]
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights)).cast("int") + 1)
    ranked = (
        sizes.withColumn("_rank", F.row_number().over(Window.orderBy(*order)) - 1)
        .withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * most_epochs)
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(every) * F.lit(share))
    )
    upto = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(upto), F.lit(0))) / (
        F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(upto), F.lit(0))
    )
    # The first source in this order that is not capped sets the level for itself and all after it.
    found = ranked.withColumn("_level", level).withColumn(
        "_level", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_rank", "_level"))).over(every)["_level"]
    )
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("_weight"), F.col("_cap")))
    return found.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    size: Column,
    weight: Column,
    doc_id: str = "doc_id",
    source: str = "source",
    tie: Column | None = None,
    seed: str = "mix",
    blocks: int | None = None,
    weights: tuple[int, ...] = (5, 2, 1),
    most_epochs: int = 3,
    share: float = 1.0,
) -> DataFrame:
    """All rows of ``docs`` with ``size``, ``source_size``, ``target`` and ``taken``.

    ``taken`` is the number of the document's words in the mix: its size times
    the complete epochs of its source, plus its words in the fractional part.
    Columns of ``docs`` with one of these names are replaced.

    Null sources are one source. Null texts have size 0, take nothing and sort
    like others. Equal keys (repeated ids) are ordered by id and ``tie``, a
    hash of the row's content; rows equal in all are interchangeable. A weight
    of 0, below or null counts as the smallest positive one. An empty table
    gives an empty result.
    """
    u, w = uniform(F.col(doc_id), seed), F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-9))
    rows = docs.select(
        F.struct(*without(docs, *ADDED)).alias("_row"),  # so that no column of the input clashes with those below
        size.alias("size"),
        (-F.log(u) / w).alias("_key"),
        F.col(doc_id).alias("_id"),
        (tie if tie is not None else F.lit(0).cast("bigint")).alias("_tie"),
        F.col(source).isNull().alias("_no_source"),
        F.coalesce(F.col(source), F.lit("")).alias("_source"),
    )
    n = blocks or max(32, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = F.percentile_approx("_key", [i / n for i in range(1, n)], 20 * n)
    sources = rows.groupBy("_no_source", "_source").agg(F.sum("size").alias("source_size"), cuts.alias("_cuts"))
    sources = sources.withColumn("source", F.when(~F.col("_no_source"), F.col("_source")))
    targets = source_targets(sources.select("source", "source_size"), weights, most_epochs, share).select(
        F.col("source").isNull().alias("_no_source"), F.coalesce("source", F.lit("")).alias("_source"), "target"
    )
    sources = sources.drop("source").join(targets, ["_no_source", "_source"])
    # One row for each source: small unless there are very many sources, so its size is checked.
    sources = cut_lineage(sources)
    if sources.count() * (8 * n + 100) <= MAX_BROADCAST_BYTES:
        sources = F.broadcast(sources)
    block = F.size(F.filter("_cuts", lambda cut: cut < F.col("_key")))
    cut = rows.join(sources, ["_no_source", "_source"]).withColumn("_block", block).drop("_cuts")
    part = ["_no_source", "_source", "_block"]
    before = (
        cut.groupBy(*part)
        .agg(F.sum("size").alias("_words"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_words").over(
                    Window.partitionBy(*part[:2]).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_words")
    )
    inside = Window.partitionBy(*part).orderBy("_key", "_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(before, part)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target") - F.col("_epochs") * F.col("source_size"))
    fraction = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before") - F.col("_inside")))
    return placed.withColumn("_epochs", epochs.cast("bigint")).select(
        "_row.*",
        "size",
        F.col("source_size").cast("bigint").alias("source_size"),
        "target",
        (F.col("size") * F.col("_epochs") + fraction).cast("bigint").alias("taken"),
    )


def repeat_taken(mixed: DataFrame, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """One row for each time a document is taken; the last may be its first words only.

    A document cut at the target keeps its first words, joined by single
    spaces, and their number of characters goes to column ``n_chars`` if one
    is named. Documents of which nothing is taken go; documents without words
    have nothing to take and go too.
    """
    (words,) = fresh_names(mixed, "_words")
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    copies = F.array_repeat(F.lit(-1), whole.cast("int"))
    copies = F.when(rest > 0, F.concat(copies, F.array(rest))).otherwise(copies)
    first_words = F.concat_ws(" ", F.slice(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)), 1, F.col(words)))
    taken = mixed.withColumn(words, F.explode(copies))
    out = taken.withColumn(text, F.when(F.col(words) > 0, first_words).otherwise(F.col(text)))
    if n_chars is not None:
        out = out.withColumn(n_chars, F.when(F.col(words) > 0, F.length(text)).otherwise(F.col(n_chars)))
    return out.drop(words)
