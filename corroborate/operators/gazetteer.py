"""Places of a gazetteer table: closure of containment, and places named in texts.

The gazetteer is a table (node, level, parent, aliases) of any size; aliases
are in the form of ``normalize_place``. ``functions/places.py`` has the same
rules for a gazetteer of a few literal rows.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.functions.places import PLACES, normalize_place
from corroborate.session import cut_lineage

#: Aliases that are sent to every executor; with more the names found in texts are shuffled to them.
BROADCAST_ALIASES = 200_000
#: Aliases whose first words are known to each task, so that runs start at these words only.
LITERAL_ALIASES = 2_000
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
_ABOVE = """
    WITH RECURSIVE above(place, within, distance, path) AS (
      SELECT node, node, 0, array(node) FROM {0}
      UNION ALL
      SELECT a.place, g.parent, a.distance + 1, array_append(a.path, g.parent) FROM above a JOIN {0} g ON g.node = a.within
      WHERE g.parent IS NOT NULL AND NOT array_contains(a.path, g.parent))
    SELECT place, within, distance FROM above"""


def gazetteer_of(spark: SparkSession, places=PLACES) -> DataFrame:
    """A literal list of places as a gazetteer table."""
    rows = [(p.node, p.level, p.parent, list(p.aliases)) for p in places]
    return spark.createDataFrame(rows, "node string, level string, parent string, aliases array<string>")


def containment(gazetteer: DataFrame) -> DataFrame:
    """(place, within, distance) of every place with itself and all that contain it, by a recursive query.

    A place that is above itself ends its own chain.
    """
    spark, name = gazetteer.sparkSession, f"gazetteer_{uuid4().hex}"
    gazetteer.select("node", "parent").createOrReplaceTempView(name)
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")  # as many rows as the closure has
    try:
        return cut_lineage(spark.sql(_ABOVE.format(name)))
    finally:
        spark.conf.set(ROW_LIMIT, before)
        spark.catalog.dropTempView(name)


def _runs(words: str, starts: str, n: int) -> Column:
    """The runs of ``n`` words at ``starts``. Words are read by position: a slice would copy the whole text for each of them."""
    run = F.transform(starts, lambda at: F.when(at + n <= F.size(words), F.concat_ws(" ", *[F.get(words, at + k) for k in range(n)])))
    return F.array_compact(run)


def named_places(texts: DataFrame, gazetteer: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, node) of the most specific places that a text names in whole words.

    The runs of words of a text, of the lengths that aliases have, are looked
    up in an index of aliases, so a text costs its words and not a search for
    each alias. Each row makes its own runs: no copy of the text goes with
    them. A place goes if the text also names one inside it. A null key or
    text gives none.
    """
    index = gazetteer.select(F.explode("aliases").alias("alias"), "node").filter("alias <> ''").distinct()
    names = F.split("alias", " ")
    sizes = index.agg(F.count("*").alias("n"), F.collect_set(F.size(names)).alias("lengths")).first()
    words = texts.select(F.col(key).alias("key"), F.split(normalize_place(text), " ").alias("words")).filter("key is not null")
    begins = lambda word: F.lit(True)
    if sizes["n"] <= LITERAL_ALIASES:
        first = [r[0] for r in index.select(names[0]).distinct().collect()]
        begins = lambda word: word.isin(first)
    starts = F.array_compact(F.transform("words", lambda word, at: F.when(begins(word), at)))
    words = words.select("key", "words", F.explode(F.array(starts)).alias("starts")).filter(F.size("starts") > 0)
    runs = [_runs("words", "starts", n) for n in sorted(sizes["lengths"]) or [1]]
    runs = words.select("key", F.explode(F.array_distinct(F.flatten(F.array(*runs)))).alias("alias"))
    lookup = F.broadcast(index) if sizes["n"] <= BROADCAST_ALIASES else index
    found = cut_lineage(runs.join(lookup, "alias").select("key", "node").distinct())
    inside = containment(gazetteer).filter("distance > 0").select(F.col("place").alias("node"), "within")
    above = found.join(inside, "node").select("key", F.col("within").alias("node")).distinct()
    return found.join(above, ["key", "node"], "left_anti").select(F.col("key").alias(key), "node")


def mentions_within(named: DataFrame, gazetteer: DataFrame, key: str) -> DataFrame:
    """How often each place, or one inside it, is named, and in how many texts."""
    inside = containment(gazetteer).select(F.col("place").alias("node"), "within")
    per_text = named.join(inside, "node").groupBy("within", key).agg(F.count("*").alias("n"))
    return per_text.groupBy("within").agg(F.sum("n").alias("mentions"), F.count("*").alias("posts"))
