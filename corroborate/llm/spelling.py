"""Spelling variants of a corpus' words, grouped under their most frequent forms.

Words are counted over all documents. Words one error apart are found by
FM-index search schemes (``fmindex``): one search matches the second half of a
word exactly and allows the error before it, the other works on reversed words
and matches the first half exactly.

Scale: no task holds the vocabulary. A search needs only words that end (for
reversed words: start) with the same letters as the query's exact half, so
words are dealt to shards by their last letters: as many as the exact half
has, six at most. A word is indexed for queries of its own length and of one
letter more or less. Shards above ``BLOCK_WORDS`` are cut into blocks, and the
shard's queries go to each of them, so a frequent ending has no large index.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.llm.common import LOWER_BYTES, distinct_spans, slices, strings, text_buffer, word_bounds
from corroborate.llm.crc import CrcShift
from corroborate.llm.fmindex import FmIndex
from corroborate.session import cut_lineage

#: Words of one index.
BLOCK_WORDS = 100_000
#: Most letters of an exact half that choose a shard.
MOST_LETTERS = 6
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b == 0xC3 for b in range(256)])


def letter_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters A-Z, a-z and U+00C0 to U+00FF (UTF-8)."""
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    return inside


def misspelt(word: bytes, h: int) -> str:
    """The word without its code point ``h`` modulo its length."""
    text = word.decode()
    at = h % len(text)
    return text[:at] + text[at + 1 :]


def count_words(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", typo_every: int | None = 97, least_letters: int = 5
) -> DataFrame:
    """(word, n): how often each word of ``least_letters`` code points or more occurs in all texts.

    With ``typo_every`` a word loses a letter where the CRC-32 of
    ``<doc_id>:<word>`` is a multiple of it. Null texts have no words; a null
    id counts as an empty one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = CrcShift()
        for batch in batches:
            for part in slices(batch, 1, bytes_at_once=1 << 21, rows_at_once=1 << 14):
                words, n = _count(part, shift, typo_every, least_letters)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.col(f"`{text}`").cast("string"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _count(part: pa.RecordBatch, shift: CrcShift, typo_every: int | None, least_letters: int) -> tuple[list[str], list[int]]:
    data, offsets = text_buffer(strings(part.column(1)))
    data = LOWER_BYTES[data]
    starts, ends, first = word_bounds(data, offsets, None, letter_bytes(data))
    code, words = distinct_spans(data, starts, ends)
    typed = Counter()
    if typo_every:
        own = np.array([zlib.crc32(w) for w in words], np.uint32)[code]
        prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in part.column(0).to_pylist()], np.uint32)
        h = shift(np.repeat(prefix, np.diff(first)), ends - starts) ^ own
        wrong = h % np.uint32(typo_every) == 0
        typed.update(misspelt(words[c], k) for c, k in zip(code[wrong].tolist(), h[wrong].tolist()))
        code = code[~wrong]
    n = np.bincount(code, minlength=len(words)).tolist()
    for word, times in zip(words, n):
        if times and len(word) >= least_letters:
            typed[word.decode()] += times
    kept = [(w, k) for w, k in typed.items() if len(w) >= least_letters]
    return [w for w, _ in kept], [k for _, k in kept]


def exact_letters(size: int, reverse: bool) -> int:
    """Letters of the half that is matched exactly."""
    return size // 2 if reverse else size - size // 2


def _tier(size, reverse: int):
    """How many last letters choose the shard of queries of this size (a column)."""
    half = F.floor(size / 2)
    return F.least(F.lit(MOST_LETTERS), half if reverse else size - half).cast("int")


def near_pairs(vocabulary: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, near, n): all pairs of words of ``vocabulary`` (word, n) one inserted, deleted or replaced code point apart.

    Each pair is given in both directions, once; ``n`` is that of ``near``.
    Words must be distinct and have five code points or more.
    """
    parts = []
    for reverse in (0, 1):
        side = vocabulary.select((F.reverse("word") if reverse else F.col("word")).alias("s"), "n", F.char_length("word").alias("size"))
        tiers = F.array_distinct(F.array(*[_tier(F.col("size") + d, reverse) for d in (-1, 0, 1)]))
        side = side.select("*", F.explode(tiers).alias("tier"), F.lit(reverse).alias("reverse"))
        parts.append(side.withColumn("asks", F.col("tier") == _tier(F.col("size"), reverse)))
    rows = parts[0].unionByName(parts[1])
    rows = rows.withColumn("ending", F.xxhash64("tier", F.expr("right(s, tier)")))
    spark = vocabulary.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), vocabulary.count() * 6 // block_words)
    rows = rows.withColumn("shard", F.pmod("ending", F.lit(shards)).cast("bigint") * 2 + F.col("reverse"))
    # One row for each shard: the number of shards bounds what is sent.
    sizes = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block_words).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(sizes), "shard")
    own = F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")
    every = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array().cast("array<int>"))
    indexed = rows.select("shard", own.alias("block"), F.lit(0).alias("asked"), "s", "n")
    asked = rows.select("shard", F.explode(every).alias("block"), F.lit(1).alias("asked"), "s", F.lit(None).cast("bigint").alias("n"))
    dealt = indexed.unionByName(asked).repartition("shard", "block").sortWithinPartitions("shard", "block", "asked", "s")
    return dealt.mapInArrow(_search, "word string, near string, n bigint")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard and block, indexed words before queries; one index is held at a time."""
    group, words, counts, index = None, [], [], None
    for batch in batches:
        shard, block, asked = (batch.column(i).to_numpy() for i in range(3))
        cut = np.flatnonzero((np.diff(shard) != 0) | (np.diff(block) != 0) | (np.diff(asked) != 0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            if group != (shard[a], block[a]):
                group, words, counts, index = (shard[a], block[a]), [], [], None
            part = batch.column(3).slice(a, b - a).to_pylist()
            if not asked[a]:
                words += part
                counts += batch.column(4).slice(a, b - a).to_pylist()
                continue
            if not words:
                continue
            index = index or FmIndex(words)
            yield _near(index, counts, part, bool(shard[a] % 2))


def _near(index: FmIndex, counts: list[int], queries: list[str], reverse: bool) -> pa.RecordBatch:
    exact = np.array([exact_letters(len(w), reverse) for w in queries], np.int64)
    found = zip(*(x.tolist() for x in index.near(queries, exact)))
    out = []
    for q, w in found:
        query, word = queries[q], index.words[w]
        if not reverse:
            out.append((query, word, counts[w]))
        elif not word.startswith(query[: len(query) - len(query) // 2]):  # else the other direction finds it as well
            out.append((query[::-1], word[::-1], counts[w]))
    columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["word", "near", "n"])


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain; every step at least doubles n, so chains are short and end.

    Each round joins the pointers with themselves and doubles their reach; it
    ends with the first round in which none moves.
    """
    pointers = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = pointers.select(F.col("word").alias("root"), F.col("root").alias("_ahead"))
        moved = cut_lineage(pointers.join(ahead, "root", "left").select("word", "root", "_ahead"))
        if moved.filter("_ahead is not null").isEmpty():
            return pointers
        pointers = moved.select("word", F.coalesce("_ahead", "root").alias("root"))


def group_variants(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    typo_every: int | None = None,
    least_letters: int = 5,
    least_count: int = 3,
    ratio: int = 2,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """All words of all texts as (word, n, n_near, form, form_n, root).

    Words are runs of letters (A-Z in lower case, a-z, U+00C0 to U+00FF) of
    ``least_letters`` code points or more (five at least) that occur ``least_count`` times or
    more. ``n_near`` counts the words one error away. ``form`` is the most
    frequent of them (of equal ones the first in code point order), if it is
    ``ratio`` times as frequent; else null. ``root`` is the end of the chain
    of forms. Null and empty texts have no words, words and texts may have any length,
    repeated rows count each. Other columns are not read. A table without words gives an empty result.
    """
    counted = count_words(docs, text, doc_id, typo_every, least_letters)
    vocabulary = cut_lineage(counted.filter(F.col("n") >= least_count))
    best = F.min_by(F.struct("near", "n"), F.struct((-F.col("n")).alias("_n"), "near"))
    near = near_pairs(vocabulary, block_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    known = vocabulary.join(near, "word", "left")
    taken = F.col("_best.n") >= ratio * F.col("n")
    known = cut_lineage(
        known.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(taken, F.col("_best.near")).alias("form"),
            F.when(taken, F.col("_best.n")).alias("form_n"),
        )
    )
    roots = follow(known.filter("form is not null"))
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
