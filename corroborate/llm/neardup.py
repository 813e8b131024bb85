"""Near-duplicate classes by BagMinHash signatures, banding and verified multiset overlap.

1. Equal texts are one *content* (the MD5 of the text); a thousand copies are
   one row from here on.
2. Contents get BagMinHash signatures, cut into bands. Contents that share a
   band are candidates: at a similarity of 0.8, 32 bands of 6 components miss
   a pair with probability 6e-5.
3. *Hub rounds.* The centre of a bucket is its content that meets most others
   in all its buckets, so a group of near copies has one hub in nearly all of
   them. Every content is compared with the centres of its buckets, n - 1
   comparisons for n contents. Links that hold are joined into classes.
4. *What is left* are contents of one bucket in different classes. Few pairs
   of them are compared as they are. Of many, each content is written as its
   difference d from the bucket's centre (the shingles that one of the two
   lacks), and the centre is moved to what most of its group have. With
   r = (1 - t) / (1 + t) and g = size(d) - r * n, two contents are linked if
   and only if g(x) + g(y) <= 2 * (shingles that d(x) and d(y) share). So
   (a) where g(x) + g(y) <= 0 they are linked whatever they share: then both
   are linked to the content of smallest g; (b) all others must share most of
   their differences. Of the one with the smaller d at most
   r * n * (1 + 1 / t) / 2 may be missing in the other, of the larger one twice
   as many. So they share one of so many and one more, counted in order of
   rarity; the shingles of one content alone come first and meet no one.
   Contents that share one are the buckets of the next hub round.
5. What that leaves is compared pair by pair, so no link is lost to the choice of centres.

Candidates always are compared by their whole shingle multisets. For that the
texts are sent to their centre's group; a group of many is dealt to several
tasks, each with a copy of the centre. A task holds one centre at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.llm.bagminhash import BagMinHash, Shingler, band_keys, overlap, weigh
from corroborate.llm.common import TERM_ANY_CASE, add_columns, fresh_names, mix64, slices, strings
from corroborate.session import cut_lineage

#: Texts of one group that are compared with one copy of its centre.
GROUP_ROWS = 256
#: Contents whose texts are looked up by a broadcast of their 16 bytes (with more the texts are shuffled), and centres sent with it.
BROADCAST_CONTENTS = 250_000
#: Pairs left for each content up to which they are compared as they are, and up to which their differences decide which are.
REST_PAIRS, DIFFERENT_PAIRS = 4, 256
#: Links of one task while classes are made.
PART_LINKS = 5_000
#: 64-bit words of a difference's bit map.
BIT_WORDS = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def content_of(text: Column) -> Column:
    """16 bytes that stand for a text; null if it has no word."""
    return F.when(text.rlike(TERM_ANY_CASE), F.unhex(F.md5(text)))


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    threshold: float = 0.8,
    width: int = 5,
    bands: int = 32,
    rows_per_band: int = 6,
) -> DataFrame:
    """All documents as (doc_id, content, class): equal ``class`` means near-duplicate, directly or by a chain of links.

    Two texts are linked if the weighted Jaccard similarity of their
    five-word shingles is ``threshold`` or more. A text of fewer words, but not
    none, is one shingle. Texts without words (null, empty, punctuation only)
    are linked to nothing: content and class are null. Repeated rows share
    their class; null ids are kept. An empty table gives an empty result.
    """
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    read = read.withColumn("content", content_of(F.col("text")))
    members = cut_lineage(_sketch(read, width, bands, rows_per_band))
    contents = members.filter("content is not null").dropDuplicates(["content"]).select("content", "n", "bands")
    buckets = contents.select(F.explode("bands").alias("key"), "content", "n")
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select("key")
    buckets = cut_lineage(buckets.join(shared, "key"))
    texts = read.filter("content is not null").select("content", "text")
    number = contents.count()
    labels = links = None
    nothing = F.array_repeat(F.lit(0).cast("bigint"), BIT_WORDS)
    start = {"g": F.lit(0.0), "size": F.lit(0).cast("bigint"), "shares": F.lit(0).cast("bigint"), "short": F.lit(True), "bits": nothing}
    groups, most = buckets.withColumns(start), -1.0
    while True:
        named = cut_lineage(_labelled(groups, labels))
        if links is not None and _pairs_between(named) <= most * number:
            break
        centred = cut_lineage(named.join(_centres(named), "key"))
        star = centred.filter((F.col("content") != F.col("centre")) & (F.col("label") != F.col("_centre_label")))
        before = links
        links, labels = _link(links, labels, compared(star.select("centre", "content").distinct(), texts, threshold, width))
        if links is before:
            break  # further rounds would change nothing
        centred = cut_lineage(_labelled(centred.drop("label", "_centre_label"), labels))
        if _pairs_between(centred) <= REST_PAIRS * number:
            groups, most = centred.drop("centre", "label"), REST_PAIRS
            continue
        met = centred.filter("content != centre").select("centre", "content").distinct()
        several = met.groupBy("centre").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("centre")
        met = met.join(several, "centre")  # a content alone with its centre has no one else to meet
        found, groups = _differences(differing(met, texts, width), threshold)
        links, labels = _link(links, labels, found)
        most = DIFFERENT_PAIRS
    rest = cut_lineage(compared(_rest_pairs(named, threshold), texts, threshold, width))
    if not rest.isEmpty():
        links, labels = _link(links, labels, rest)
    return members.select("doc_id", "content").join(labels, "content", "left").select(
        "doc_id", "content", F.coalesce("label", "content").alias("class")
    )


def _sketch(read: DataFrame, width: int, bands: int, rows_per_band: int) -> DataFrame:
    def build():
        shingle, sign = Shingler(width), BagMinHash(bands * rows_per_band)

        def compute(texts: pa.Array) -> list[pa.Array]:
            shingles = shingle(texts)
            keys = band_keys(sign([weigh(s) for s in shingles]), rows_per_band)
            flat = pa.array(keys.reshape(-1).view(np.int64))
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands)
            return [pa.array([len(s) for s in shingles], pa.int64()), pa.ListArray.from_arrays(offsets, flat)]

        return compute

    return add_columns(read, "text", "n bigint, bands array<bigint>", build).drop("text")


def _labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Buckets whose contents are in more than one class, with the classes."""
    if labels is None:
        return buckets.withColumn("label", F.col("content"))
    named = buckets.join(labels, "content", "left").withColumn("label", F.coalesce("label", "content"))
    mixed = named.groupBy("key").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).filter("_a < _b")
    return named.join(mixed.select("key"), "key")


def _alike(n: Column, m: Column, threshold: float) -> Column:
    """Sizes that allow the similarity."""
    return F.least(n, m) >= F.lit(threshold - 1e-9) * F.greatest(n, m)


def _link(links: DataFrame | None, labels: DataFrame | None, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links so far and the classes they make."""
    found = cut_lineage(found.select("centre", "content"))
    if links is not None and found.isEmpty():
        return links, labels
    links = found if links is None else links.unionByName(found)
    return links, components(links, "centre", "content")


def _centres(named: DataFrame) -> DataFrame:
    """The centre of each bucket: its content with most company in all buckets."""
    sizes = named.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"))
    company = named.join(sizes, "key").groupBy("content").agg(F.sum("_rows").alias("_company"))
    known = named.select("key", "content", "label").join(company, "content")
    best = known.groupBy("key").agg(F.max_by(F.struct("content", "label"), F.struct("_company", "content")).alias("c"))
    return best.select("key", F.col("c.content").alias("centre"), F.col("c.label").alias("_centre_label"))


def _pairs_between(named: DataFrame) -> int:
    """Pairs of contents of different classes that all buckets give, at most."""
    count = F.count(F.lit(1)).cast("double")
    each = named.groupBy("key", "label").agg(count.alias("_n"), F.count_if("short").cast("double").alias("_s"))
    each = each.groupBy("key").agg((F.sum("_n") * F.sum("_s") - F.sum(F.col("_n") * F.col("_s"))).alias("_pairs"))
    return int(each.agg(F.sum("_pairs")).first()[0] or 0)


def _differences(met: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links that differences from a centre prove, and buckets of contents that share some of them.

    ``met`` has centre, content, n and ``d``, the content's difference. A
    centre's group is the contents compared with it.
    """
    numbered_pairs = met.select("*", F.xxhash64("centre").alias("group"), F.monotonically_increasing_id().alias("pair"))
    met = cut_lineage(numbered_pairs)  # numbers stand for the names of contents in the many rows below
    each = met.select("pair", "group", F.explode("d").alias("e"))
    groups = met.groupBy("group").agg(F.count(F.lit(1)).alias("members"))
    often = each.groupBy("group", "e").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").join(groups, "group")
    often = cut_lineage(often.withColumn("most", 2 * F.col("times") > F.col("members")))
    common = cut_lineage(each.join(often.drop("members"), ["group", "e"]).select("pair", "e", "times", "most"))
    # The centre moves to what most have: a shingle that most differ in becomes a difference of the others.
    moved = often.filter("most").select("group", "e", (F.col("members") - F.col("times")).alias("times"))
    added = met.select("pair", "group").join(moved, "group").join(common.filter("most").select("pair", "e"), ["pair", "e"], "left_anti")
    added = added.select("pair", "e", "times", F.lit(False).alias("most"), F.lit(1).alias("new"))
    rows = common.withColumn("new", F.lit(0)).unionByName(added).withColumn("kept", ~F.col("most") & (F.col("times") > 1))
    bit = "if(kept and pmod(e, {0}) div 64 = {1}, shiftleft(1L, cast(pmod(e, 64) as int)), 0L)"
    words = [F.bit_or(F.expr(bit.format(64 * BIT_WORDS, k))) for k in range(BIT_WORDS)]
    now = rows.groupBy("pair").agg(
        F.count_if("kept").alias("_kept"),
        F.count_if((F.col("new") == 1) & (F.col("times") == 1)).alias("_one"),
        F.sum(1 - F.col("new")).alias("_common"),
        F.sort_array(F.collect_list(F.when(F.col("kept"), F.struct("times", "e")))).alias("es"),
        F.array(*words).alias("bits"),
    )
    alone = F.size("d") - F.coalesce("_common", F.lit(0)) + F.coalesce("_one", F.lit(0))
    state = met.join(now, "pair", "left").withColumn("alone", alone.cast("bigint"))
    state = state.withColumns({"shares": F.coalesce("_kept", F.lit(0)), "size": F.col("alone") + F.coalesce("_kept", F.lit(0))})
    state = state.select("centre", "content", "n", "group", "alone", "size", "shares", "es", "bits")
    r = (1 - threshold) / (1 + threshold)
    state = cut_lineage(state.withColumn("g", F.col("size") - F.lit(r) * F.col("n")))
    least = state.groupBy("group").agg(F.min(F.struct("g", "content")).alias("least"))
    state = state.join(least, "group")
    sure = (F.col("g") + F.col("least.g") <= 1e-9) & (F.col("content") != F.col("least.content"))
    found = state.filter(sure).select(F.col("least.content").alias("centre"), "content")
    some = F.greatest(F.lit(1), F.ceil((F.col("g") + F.col("least.g")) / 2 - 1e-9))
    missing = r * (1 + 1 / threshold)  # share of a content's size that the other may lack of its differences

    def reach(share: float) -> Column:
        need = F.greatest(some, F.ceil(F.col("size") - F.lit(share) * F.col("n") - 1e-9))
        return (F.col("size") - need + 1 - F.col("alone")).cast("int")

    reaching = state.withColumns({"reach": reach(missing), "near": reach(missing / 2)}).filter("reach > 0 and shares > 0")
    first = reaching.select(
        "group", "content", "n", "g", "size", "shares", "near", "bits", F.posexplode(F.slice("es", F.lit(1), F.col("reach"))).alias("_at", "_e")
    )
    key = F.xxhash64("group", "_e.e").alias("key")
    first = first.select(key, "content", "n", "g", "size", "shares", (F.col("_at") < F.col("near")).alias("short"), "bits")
    several = first.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key")
    return found, cut_lineage(first.join(several, "key"))


def _rest_pairs(named: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different classes in a bucket that their sizes and differences allow.

    The content with the smaller difference meets the other by one of its
    nearest shingles. What both share is at most what is left of one without
    the bits that the other lacks.
    """
    left = named.filter("short").select("key", "content", "n", "g", "size", "shares", "label", "bits")
    names = (("content", "centre"), ("n", "m"), ("g", "h"), ("size", "other_size"), ("shares", "other_shares"), ("label", "other"), ("bits", "other_bits"))
    right = named.select("key", *[F.col(c).alias(name) for c, name in names])

    def lacked(a: str, b: str) -> Column:
        return reduce(lambda x, y: x + y, [F.bit_count(F.col(a)[k].bitwiseAND(F.bitwise_not(F.col(b)[k]))) for k in range(BIT_WORDS)])

    shared = F.least(F.col("shares") - lacked("bits", "other_bits"), F.col("other_shares") - lacked("other_bits", "bits"))
    fits = (F.col("g") + F.col("h") <= 2 * shared + 1e-9) & _alike(F.col("n"), F.col("m"), threshold)
    smaller = F.struct("size", "content") < F.struct("other_size", "centre")
    return left.join(right, "key").filter((F.col("label") != F.col("other")) & smaller & fits).select("centre", "content").distinct()


def compared(pairs: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """The pairs (centre, content) whose multisets of shingles overlap by ``threshold`` or more, with ``similarity``."""

    def judge(centre, other):
        similarity = overlap(centre, other)
        return (similarity,) if similarity >= threshold - 1e-12 else None

    return _meet(pairs, texts, width, judge, [("similarity", "double", pa.float64())])


def differing(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (centre, content) with the content's size ``n`` and ``d``, the shingles (each with its number) that one of them lacks."""

    def difference(centre, other):
        return int(other[1].sum()), np.setxor1d(numbered(centre), numbered(other), assume_unique=True).view(np.int64)

    return _meet(pairs, texts, width, difference, [("n", "bigint", pa.int64()), ("d", "array<bigint>", pa.list_(pa.int64()))])


def numbered(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A multiset as a set: the first, second, ... time of each shingle."""
    x, p = bag
    again, times = np.repeat(x[p > 1], p[p > 1] - 1), p[p > 1] - 1
    number = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times) + 1
    return np.concatenate((x, mix64(again + number.astype(np.uint64) * _STEP)))


def _meet(pairs: DataFrame, texts: DataFrame, width: int, judge: Callable, kinds: list[tuple]) -> DataFrame:
    """``judge`` of the shingles of both texts of each pair (None: no row)."""
    pairs = cut_lineage(pairs)
    large = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("_parts")).filter("_parts > 1")
    large = cut_lineage(large)
    if large.count() <= BROADCAST_CONTENTS:
        large = F.broadcast(large)
    parts = F.coalesce("_parts", F.lit(1))
    salt = F.pmod(F.xxhash64("content"), parts).cast("int")
    roles = pairs.join(large, "centre", "left").select("content", "centre", salt.alias("salt"), F.lit(1).alias("role"))
    own = pairs.select("centre").distinct().join(large, "centre", "left").select(
        F.col("centre").alias("content"), "centre", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), F.lit(0).alias("role")
    )
    roles = roles.unionByName(own)
    needed = cut_lineage(roles.select("content").distinct())
    if needed.count() <= BROADCAST_CONTENTS:
        needed = F.broadcast(needed)
    one = texts.join(needed, "content", "left_semi").groupBy("content").agg(F.min("text").alias("text"))
    sent = one.join(roles, "content").select("centre", "salt", "role", "content", "text")
    sent = sent.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role")
    schema = pa.schema([("centre", pa.binary()), ("content", pa.binary()), *[(name, kind) for name, _, kind in kinds]])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, group, bag = Shingler(width), None, None
        for batch in batches:
            for part in slices(batch, 4):
                out = {name: [] for name in schema.names}
                rows = zip(*(part.column(i).to_pylist() for i in range(4)), shingle(strings(part.column(4))))
                for centre, salt, role, content, shingles in rows:
                    if role == 0:
                        group, bag = (centre, salt), weigh(shingles)
                        continue
                    assert group == (centre, salt), "a group's centre comes before its texts"
                    found = judge(bag, weigh(shingles))
                    if found is not None:
                        for name, value in zip(out, (centre, content, *found)):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema)

    return sent.mapInArrow(compare, ", ".join(["centre binary", "content binary", *[f"{name} {kind}" for name, kind, _ in kinds]]))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(content, label) of every end of a link; ``label`` is the smallest content of its component.

    Alternates large-star and small-star steps: every node hands its larger
    (then its smaller) neighbours the smallest one it knows. The number of
    rounds grows with the logarithm of the longest chain. Each round is
    checkpointed; ends when a round changes no link.
    """
    parts = max(2, -(-links.count() // PART_LINKS))

    def few(df: DataFrame) -> DataFrame:
        return df.coalesce(parts)  # links are small rows, and every round has several exchanges of them

    edges = few(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = few(both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u"))
        large = few(large.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        least = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = few(large.join(least, "u").select(F.col("u"), F.col("v"), F.col("m")))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = few(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct())
        edges = cut_lineage(edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    own = edges.select(F.col("v").alias("content"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("content"), F.col("v").alias("label")).unionByName(own)


def misses(similarity: float, bands: int = 32, rows_per_band: int = 6) -> float:
    """Probability that a pair of this similarity shares no band."""
    return math.pow(1 - similarity**rows_per_band, bands)


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of each class stays: the one of smallest id (null last). Texts without words all stay.

    Of repeated rows that are alike in id and words one stays. All columns of
    ``docs`` are kept.
    """
    classes = near_duplicates(docs, text, doc_id, **options).filter("content is not null")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")
    stay = classes.groupBy("class").agg(F.min(first).alias("k"))
    content, other, other_id = fresh_names(docs, "_content", "_stays", "_stays_id")
    stay = stay.select(F.col("k.content").alias(other), F.col("k.doc_id").alias(other_id))
    named = docs.withColumn(content, content_of(F.col(f"`{text}`").cast("string")))
    chosen = named.join(stay, (F.col(content) == F.col(other)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(other_id)))
    chosen = chosen.dropDuplicates([content]).select(*[F.col(f"`{c}`") for c in docs.columns])
    wordless = named.filter(F.col(content).isNull()).drop(content)
    return chosen.unionByName(wordless)
