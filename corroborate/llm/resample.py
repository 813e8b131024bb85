"""Documents that resemble a target, drawn by importance resampling, and exact ranks by regular sampling.

1. *Buckets.* The runs of one to three words of all documents and of the
   target are counted in hash buckets, one histogram for each task. A bucket's
   gain is the logarithm of its share in the target over its share here.
2. *Weights.* A document's weight is the sum of gains of its features; a
   Gumbel number that follows from its id makes the largest scores a weighted
   sample without replacement.
3. *Ranks by parallel sorting with regular sampling.* Each task sorts its rows
   to a run. Rows at regular places of the runs give splitters at regular
   places among them. Rows go to the segment between two splitters, segments
   are merged each for itself, and the number of rows in the segments before
   makes their ranks exact. A splitter tells even equal rows apart (by run and
   place), so no segment holds much more than its share. Segments that lie
   wholly behind the drawn ranks are not exchanged at all.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.llm.common import (
    IS_TERM_BYTE,
    LOWER_BYTES,
    add_columns,
    distinct_spans,
    received,
    send,
    slices,
    strings,
    text_buffer,
    word_bounds,
)
from corroborate.llm.crc import CrcShift
from corroborate.session import cut_lineage

#: Rows of all runs together that are looked at to choose splitters (one for each run at least).
MAX_SAMPLES = 20_000


class WordRuns:
    """Hash buckets of all runs of up to ``longest`` consecutive words of a string array."""

    def __init__(self, buckets: int, longest: int = 3):
        self.buckets, self.longest, self.shift = buckets, longest, CrcShift()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Number of words of each text; for each length the buckets of its runs and the edges of each text's share."""
        data, offsets = text_buffer(texts)
        data = LOWER_BYTES[data]
        starts, ends, first = word_bounds(data, offsets, IS_TERM_BYTE)
        code, words = distinct_spans(data, starts, ends)
        alone = np.array([zlib.crc32(w) for w in words], np.uint32)[code]
        spaced = np.array([zlib.crc32(b" " + w) for w in words], np.uint32)[code]
        more = np.array([len(w) + 1 for w in words], np.int64)[code]
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        out, run = [], alone
        for n in range(1, self.longest + 1):
            if n > 1:
                run = self.shift(run[:-1], more[n - 1 :]) ^ spaced[n - 1 :] if len(run) else run
            inside = text[: len(run)] == text[n - 1 :] if len(run) else np.zeros(0, bool)
            upto = np.concatenate(([0], np.cumsum(inside)))
            out.append(((run[inside] % np.uint32(self.buckets)).astype(np.int64), upto[np.minimum(first, len(run))]))
        return np.diff(first), out


def histogram(docs: DataFrame, text: str, buckets: int) -> np.ndarray:
    """How many features of all texts each bucket holds. One number for each bucket comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = WordRuns(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                for found, _ in runs(strings(part.column(0)))[1]:
                    held += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["bucket", "n"])

    counted = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target over that in the documents."""
    n, s, t = float(len(here)), float(here.sum()), float(there.sum())
    ratios = [(b + 1.0) * (s + n) / ((a + 1.0) * (t + n)) for a, b in zip(here.tolist(), there.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weigh_documents(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_features and weight (sum of gains of all features)."""
    sent = send(docs.sparkSession, gain)

    def build():
        gain = received(sent)
        runs = WordRuns(len(gain))

        def compute(texts: pa.Array) -> list[pa.Array]:
            n_words, found = runs(texts)
            features, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for buckets, edges in found:
                sums = np.concatenate(([0], np.cumsum(gain[buckets])))
                features += np.diff(edges)
                weight += sums[edges[1:]] - sums[edges[:-1]]
            return [pa.array(x, pa.int64()) for x in (n_words, features, weight)]

        return compute

    return add_columns(docs, text, "n_words bigint, n_features bigint, weight bigint", build)


def gumbel(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number that follows from ``key`` (null: empty) and ``seed``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    target_text: str = "text",
    buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 5,
    seed: int = 42,
) -> DataFrame:
    """All documents as (doc_id, n_words, n_features, weight, score, rank).

    Of the N documents with ``least_words`` words or more the
    floor(N * percent / 100) of largest score are drawn and get ranks from 1
    on; equal scores go by ascending id, null last. Others have a null rank.
    Ids are integers; null ids share one random number. Null texts have no
    words and weight 0. Texts of any length are read whole. Repeated rows each
    count and each get a rank of their own; which of two equal rows comes
    first is open. Other columns of ``docs`` are not read. An empty table
    gives an empty result; an empty target is one without features.
    """
    gain = gains(histogram(docs, text, buckets), histogram(target, target_text, buckets))
    named = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    weighed = weigh_documents(named, gain).drop("text")
    rows = cut_lineage(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    ranked = rank_rows(rows.filter(F.col("n_words") >= least_words), percent)
    return ranked.unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint")))


def sort_keys(score: pa.Array, ids: pa.Array, run: pa.Array, place: pa.Array) -> np.ndarray:
    """Byte strings whose order is: descending score, ascending id (null last), run, place."""
    out = np.zeros((len(score), 33), np.uint8)
    flip = np.uint64(1 << 63)
    columns = [~(score.to_numpy().view(np.uint64) ^ flip)]
    columns += [x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ flip for x in (ids, run, place)]
    for at, column in zip((0, 9, 17, 25), columns):
        out[:, at : at + 8] = column.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8] = ids.is_null().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(out).view("S33").reshape(-1)


def rank_rows(rows: DataFrame, percent: int = 100, segments: int | None = None) -> DataFrame:
    """``rows`` (with ``score`` and ``doc_id``) and their ``rank``: the best ``percent`` of 100, others null."""
    fields = rows.columns
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            runs = pa.array(np.full(batch.num_rows, run, np.int64))
            places = pa.array(np.arange(place, place + batch.num_rows))
            place += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, runs, places], [*fields, "_run", "_place"])

    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    local = rows.sortWithinPartitions(*order).mapInArrow(number, f"{schema}, _run bigint, _place bigint")
    local = cut_lineage(local)
    sizes = local.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    counted = sizes.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("runs")).first()
    n, runs = counted["n"] or 0, counted["runs"]
    if not n:
        return rows.withColumn("rank", F.lit(None).cast("bigint"))
    segments = segments or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    per_run = max(1, min(segments, MAX_SAMPLES // runs))
    step = F.ceil(F.col("_n") / per_run)
    regular = local.join(sizes, "_run").filter(F.col("_place") % step == F.floor(step / 2))
    samples = regular.select("score", "doc_id", "_run", "_place").toArrow().combine_chunks()
    keys = np.sort(sort_keys(*[samples.column(i).combine_chunks() for i in range(4)]))
    splitters = keys[np.arange(1, segments) * len(keys) // segments]
    at = [fields.index("score"), fields.index("doc_id"), len(fields), len(fields) + 1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segment = np.searchsorted(splitters, sort_keys(*[batch.column(i) for i in at]), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment.astype(np.int64))], [*batch.schema.names, "_segment"])

    dealt = local.mapInArrow(deal, f"{schema}, _run bigint, _place bigint, _segment bigint")
    # One number for each segment comes to the driver.
    held = {r["_segment"]: r["n"] for r in dealt.groupBy("_segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn, before, seen = percent * n // 100, [], 0
    for segment in range(segments):
        before.append((segment, seen))
        seen += held.get(segment, 0)
    last = max((segment for segment, b in before if b < drawn), default=-1)
    offsets = rows.sparkSession.createDataFrame(before, "_segment bigint, _before bigint")
    inside = F.row_number().over(Window.partitionBy("_segment").orderBy(*order, "_run", "_place"))
    ranked = dealt.filter(F.col("_segment") <= last).withColumn("_inside", inside).join(F.broadcast(offsets), "_segment")
    rank = F.col("_before") + F.col("_inside")
    ranked = ranked.select(*fields, F.when(rank <= drawn, rank).alias("rank"))
    rest = dealt.filter(F.col("_segment") > last).select(*fields, F.lit(None).cast("bigint").alias("rank"))
    return ranked.unionByName(rest)
