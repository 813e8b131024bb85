"""Documents packed into sequences of equal length with next to no padding, by cutting-stock column generation.

1. *Ids.* Texts are encoded once, to a table in the shared folder; what
   follows works on lengths, one small row for each document.
2. *Rests.* A document of n ids gives n // length whole sequences and a rest.
   The histogram of rests (``length / step`` classes) goes to the driver, where
   ``cutting_stock`` finds patterns of rests that fill a sequence.
3. *Assignment.* Documents are ranked inside their class. The rank alone says
   which pattern, which of its sequences and which place in it a rest takes.
4. *Filling.* Rests are rounded up to classes, so a pattern leaves some ids of
   room. The whole parts of the first long documents (where they do not
   suffice, also a few documents of each class) are laid out as one stream
   that fills the room; stream and rooms are cut along an axis of ids in
   blocks. The stream's end is cut into powers of two, so nothing is padded.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corroborate.llm.common import received, send, slices, strings
from corroborate.llm.cutting_stock import plan
from corroborate.llm.token_files import BYTES_AT_ONCE, load_tokenizer, worker_cache
from corroborate.session import cut_lineage, shared_folder

#: Ids of the stream that are cut in one group.
BLOCK_IDS = 1 << 16
PIECES = "_key bigint, start bigint, length bigint, sequence_id bigint, offset bigint"


def encode(docs: DataFrame, tokenizer_path: str, text: str, doc_id: str, end_id: int) -> DataFrame:
    """(doc_id, _key, n, _hash, ids) in the shared folder; ``ids`` are unsigned little-endian integers of 16 or 32 bits."""
    spark = docs.sparkSession
    dtype = "<u2" if max(load_tokenizer(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end, key = worker_cache(tokenizer_path, dtype), np.array([end_id], dtype), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, 1, BYTES_AT_ONCE):
                found = [np.concatenate((ids, end)) for ids in cache.encode(strings(part.column(1)))]
                keys = np.arange(key, key + len(found))
                key += len(found)
                columns = [part.column(0), pa.array(keys), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_key", "n", "ids"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    made = rows.mapInArrow(run, "doc_id bigint, _key bigint, n bigint, ids binary")
    path = f"{shared_folder(spark)}/packing-{uuid.uuid4().hex}"
    made.withColumn("_hash", F.xxhash64("ids")).write.parquet(path)
    return spark.read.parquet(path).withColumn("_wide", F.lit(dtype == "<u4"))


def prefix_sums(rows: DataFrame, order: list, values: dict[str, str]) -> DataFrame:
    """``rows`` with, for each (value, name), the sum of the value column over all rows before in ``order``.

    Rows are dealt by ranges of ``order`` and summed inside; one row for each
    part meets in the sum over parts. ``order`` must be total.
    """
    fields, spark = rows.columns, rows.sparkSession
    at = [fields.index(v) for v in values]
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(len(at), np.int64)
        for batch in batches:
            columns = list(batch.columns)
            for i, place in enumerate(at):
                upto = np.cumsum(batch.column(place).to_numpy())
                columns.append(pa.array(seen[i] + upto - batch.column(place).to_numpy()))
                seen[i] += upto[-1] if len(upto) else 0
            columns.append(pa.array(np.full(batch.num_rows, part, np.int64)))
            yield pa.RecordBatch.from_arrays(columns, [*fields, *values.values(), "_part"])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    local = cut_lineage(sorted_rows.mapInArrow(run, f"{schema}, {', '.join(f'{n} bigint' for n in values.values())}, _part bigint"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("_part").agg(*[F.sum(v).alias(f"_sum_{i}") for i, v in enumerate(values)])
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_sum_{i}").over(earlier), F.lit(0)).alias(f"_sum_{i}") for i in range(len(at))])
    # One row for each part: the number of parts bounds what is sent.
    whole = local.join(F.broadcast(totals), "_part")
    return whole.select(*fields, *[(F.col(n) + F.col(f"_sum_{i}")).cast("bigint").alias(n) for i, n in enumerate(values.values())])


class Places:
    """Which sequence and which place in it the piece of a class and rank takes."""

    def __init__(self, patterns: list[tuple[np.ndarray, int]], units: int):
        self.bins = sum(times for _, times in patterns)
        self.of = {}
        for c in range(units):
            rows, first, rank = [], 0, 0
            for pattern, times in patterns:
                if pattern[c]:
                    rows.append((rank, pattern[c], first))
                    rank += int(pattern[c]) * times
                first += times
            self.of[c + 1] = np.array(rows or [(0, 1, 0)], np.int64).T

    def __call__(self, classes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.zeros(len(classes), np.int64), np.zeros(len(classes), np.int64)
        for c in np.unique(classes).tolist():
            mine = classes == c
            start, width, first = self.of[c]
            at = np.searchsorted(start, ranks[mine], "right") - 1
            inside = ranks[mine] - start[at]
            sequence[mine], slot[mine] = first[at] + inside // width[at], inside % width[at]
        return sequence, slot


def reserve(counts: np.ndarray, tokens: int, stream: int, length: int) -> np.ndarray:
    """How many documents of each class go to the stream, so that it fills the room that patterns leave."""
    room = length * sum(times for _, times in plan(counts)) - tokens
    if stream >= room:
        return np.zeros_like(counts)
    return np.ceil(counts * ((room - stream) / (room + tokens))).astype(np.int64)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    text: str = "text",
    doc_id: str = "doc_id",
    end_id: int = 1,
    length: int = 2048,
    step: int = 16,
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` holds the piece's ids as unsigned little-endian 32-bit integers. A
    document is its whole text's ids and ``end_id``; each id lies in exactly
    one piece. A null or empty text is its end id alone. Texts may have any
    length. Repeated rows are packed each. Null ids are kept; ids are
    integers. Other columns are not read. An empty table gives no pieces.
    Sequences are filled from offset 0 without gaps and hold ``length`` ids or
    a power of two, but for those that are left when no stream is left.
    """
    assert length % step == 0
    spark, units = docs.sparkSession, length // step
    stored = encode(docs, tokenizer_path, text, doc_id, end_id)
    whole = F.col("n") - F.col("n") % length
    rows = stored.select(
        F.ceil((F.col("n") % length) / step).cast("bigint").alias("_class"), "doc_id", "_hash", "_key", "n", whole.alias("_whole"), F.lit(1).cast("bigint").alias("_one")
    )
    rows = prefix_sums(rows, ["_class", "doc_id", "_hash", "_key"], {"_one": "_place", "_whole": "_at"})
    # One row for each class comes to the driver.
    held = rows.groupBy("_class").agg(F.count(F.lit(1)), F.sum(F.col("n") - F.col("_whole")), F.sum("_whole")).collect()
    counts, before, tokens, stream = np.zeros(units + 1, np.int64), np.zeros(units + 2, np.int64), 0, 0
    for c, n, rests, wholes in held:
        counts[c], tokens, stream = n, tokens + rests, stream + wholes
    before[1:] = np.cumsum(counts)
    given = np.concatenate(([0], reserve(counts[1:], tokens, stream, length)))
    patterns = plan((counts - given)[1:])
    places = Places(patterns, units)
    first_given = before[1:] - given  # global place of the first reserved document of a class
    limits = F.array(*[F.lit(int(x)) for x in first_given])
    reserved = (F.col("_class") > 0) & (F.col("_place") >= F.element_at(limits, F.col("_class").cast("int") + 1))
    rows = rows.drop("_one").withColumn("_streamed", F.when(reserved, F.col("n")).otherwise(F.col("_whole")))
    if given.any():
        rows = prefix_sums(rows.drop("_at"), ["_place"], {"_streamed": "_at"})
        tokens -= rows.filter(F.col("_streamed") > F.col("_whole")).agg(F.sum(F.col("n") % length)).first()[0] or 0
        stream = rows.agg(F.sum("_streamed")).first()[0]
    room = length * places.bins - tokens
    items = _assigned(rows.filter("n > _streamed"), places, before)
    # The stream ends with the document that fills the last room (with reserved documents it is all there is).
    end = stream if given.any() else rows.filter((F.col("_streamed") > 0) & (F.col("_at") >= room)).agg(F.min("_at")).first()[0]
    end = stream if end is None else end
    tail = _tail(max(0, end - room), length)
    filled = _fill(rows.filter((F.col("_streamed") > 0) & (F.col("_at") < end)), items, places.bins, tail, room, end, length, block_ids)
    first = places.bins + len(tail)
    aligned = rows.filter((F.col("_streamed") > 0) & (F.col("_at") >= end)).select(
        "_key", F.posexplode(F.sequence(F.lit(0), F.col("_whole") - length, F.lit(length))).alias("_i", "start"), "_at"
    )
    aligned = aligned.select("_key", "start", F.lit(length).cast("bigint").alias("length"), (first + F.floor((F.col("_at") - end) / length) + F.col("_i")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    pieces = items.select("_key", "start", "length", "sequence_id", "offset").unionByName(filled).unionByName(aligned)
    return _with_ids(stored, pieces)


def _assigned(rests: DataFrame, places: Places, before: np.ndarray) -> DataFrame:
    """Rests in their sequences; a sequence has as many rests as units at most, so its sum runs over few rows."""
    sent = send(rests.sparkSession, (places, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, before = received(sent)
        for batch in batches:
            classes = batch.column(1).to_numpy()
            sequence, slot = places(classes, batch.column(2).to_numpy() - before[classes])
            columns = [batch.column(0), *batch.columns[3:], batch.column(1), pa.array(sequence), pa.array(slot)]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "start", "length", "_class", "sequence_id", "_slot"])

    read = rests.select("_key", "_class", "_place", F.col("_whole").alias("start"), (F.col("n") - F.col("_whole")).alias("length"))
    put = read.mapInArrow(run, "_key bigint, start bigint, length bigint, _class bigint, sequence_id bigint, _slot bigint")
    inside = Window.partitionBy("sequence_id").orderBy(F.col("_class").desc(), "_slot")
    offset = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut_lineage(put.withColumn("offset", offset))


def _tail(ids: int, length: int) -> list[int]:
    """Sizes of the sequences behind the last room: full ones, then powers of two."""
    rest = ids % length
    return [length] * (ids // length) + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def _fill(streamed: DataFrame, items: DataFrame, bins: int, tail: list[int], room: int, end: int, length: int, block_ids: int) -> DataFrame:
    """The stream cut along the rooms of all sequences, block by block of its ids."""
    used = items.groupBy("sequence_id").agg(F.sum("length").cast("bigint").alias("_used"))
    used = used.withColumn("_room", length - F.col("_used")).filter("_room > 0")
    rooms = prefix_sums(used, ["sequence_id"], {"_room": "_from"}).filter(F.col("_from") < end)
    # The tail is at most one document's whole sequences and a few powers of two, or the last reserved ones.
    edges = room + np.concatenate(([0], np.cumsum(tail, dtype=np.int64))).astype(np.int64)
    sent = send(streamed.sparkSession, edges)

    def over_blocks(first: str, size: str):
        last = F.least(F.col(first) + F.col(size), F.lit(end)) - 1
        return F.explode(F.sequence(F.floor(F.col(first) / block_ids), F.floor(last / block_ids)))

    documents = streamed.select("_key", "_at", "_streamed", over_blocks("_at", "_streamed").alias("_block"))
    rooms = rooms.select("sequence_id", "_used", "_from", "_room", over_blocks("_from", "_room").alias("_block"))

    def cut(key, left: pa.Table, right: pa.Table) -> pa.Table:
        edges = received(sent)
        low = key[0].as_py() * block_ids
        high = min(low + block_ids, end)
        left, right = left.sort_by("_at"), right.sort_by("_from")
        keys, at, size = (left.column(i).to_numpy() for i in range(3))
        sequence, offset, begin, width = (right.column(i).to_numpy() for i in range(4))
        a, b = np.searchsorted(edges, low, "right") - 1, np.searchsorted(edges, high)
        behind = np.arange(max(a, 0), min(b, len(edges) - 1))
        sequence = np.concatenate((sequence, bins + behind))
        offset = np.concatenate((offset, np.zeros(len(behind), np.int64)))
        begin = np.concatenate((begin, edges[behind]))
        width = np.concatenate((width, np.diff(edges)[behind]))
        starts = np.unique(np.concatenate((at, begin)))
        starts = starts[(starts >= low) & (starts < high)]
        d, s = np.searchsorted(at, starts, "right") - 1, np.searchsorted(begin, starts, "right") - 1
        ends = np.minimum(at[d] + size[d], begin[s] + width[s])
        columns = (keys[d], starts - at[d], ends - starts, sequence[s], offset[s] + starts - begin[s])
        return pa.table([pa.array(x.astype(np.int64)) for x in columns], ["_key", "start", "length", "sequence_id", "offset"])

    return documents.groupBy("_block").cogroup(rooms.groupBy("_block")).applyInArrow(cut, PIECES)


def _with_ids(stored: DataFrame, pieces: DataFrame) -> DataFrame:
    """Each document's pieces meet its ids once."""
    together = pieces.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("_pieces"))
    joined = stored.join(together, "_key").select("doc_id", "n", "_wide", "ids", "_pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "doc_tokens", "start", "length", "sequence_id", "offset", "ids"]
        for batch in batches:
            for part in slices(batch, 3):
                lists = part.column(4)
                which = lists.value_parent_indices()
                flat = lists.flatten()
                row, start, size = which.to_numpy(), flat.field("start").to_numpy(), flat.field("length").to_numpy()
                dtype = "<u4" if part.column(2)[0].as_py() else "<u2"
                read = [np.frombuffer(x, dtype) for x in part.column(3).to_pylist()]
                ids = [read[r][a : a + k].astype("<u4").tobytes() for r, a, k in zip(row.tolist(), start.tolist(), size.tolist())]
                kept = [part.column(0).take(which), part.column(1).take(which), *[flat.field(n) for n in names[2:6]], pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(kept, names)

    return joined.mapInArrow(run, "doc_id bigint, doc_tokens bigint, start bigint, length bigint, sequence_id bigint, offset bigint, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences from the pieces of ``pack``: sequence_id, n_tokens, ids (32-bit) and the end of each piece in it."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    made = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ordered.alias("p"))
    ids = F.aggregate("p", F.to_binary(F.lit(""), F.lit("utf-8")), lambda whole, p: F.concat(whole, p["ids"]))
    ends = F.transform("p", lambda p: p["offset"] + p["length"])
    return made.select("sequence_id", "n_tokens", ids.alias("ids"), ends.alias("piece_ends"))
