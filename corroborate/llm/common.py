"""Shared pieces: words, letter case, tables, Arrow streaming and text buffers."""

from __future__ import annotations

import ctypes
import pickle
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

import corroborate

#: Characters that end a word: every ASCII character but 0-9 and a-z (texts are lower-cased first).
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text that is not lower-cased, so that offsets stay those of the original.
TERM_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words between ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Byte table: A-Z to a-z, bytes that end a word to a space. Bytes from 0x80 on belong to words.
TERM_BYTES = bytes(
    b + 32 if b in _UPPER else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
#: Bytes that stand in words between ASCII white space, as a lookup table.
IS_TOKEN_BYTE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: Bytes that stand in a term, A-Z included.
IS_TERM_BYTE = np.array([b in _UPPER or TERM_BYTES[b] != 0x20 for b in range(256)])
#: A-Z to a-z, everything else as it is.
LOWER_BYTES = np.array([b + 32 if b in _UPPER else b for b in range(256)], np.uint8)

_TERM_ANY_CASE = re.compile(TERM_ANY_CASE)

#: Rows of whole texts that go to a Python worker at once. Spark's 10,000 are some 30 MB, held by both sides and copied there.
BATCH_ROWS = 2_000


def prepare(spark: SparkSession) -> None:
    """Ship this package's functions by value, so that executors need no copy of it, and texts in small batches."""
    cloudpickle.register_pickle_by_value(corroborate)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system: a worker serves many tasks, and what one has freed would stay with it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def send(spark: SparkSession, value):
    """Broadcast an object of this package by value; ``received`` gives it in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent):
    return pickle.loads(sent.value)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER.decode(), _UPPER.decode().lower())


def terms(text: str) -> list[bytes]:
    """Words of a text in lower case (A-Z only), as UTF-8."""
    return text.encode("utf-8", "replace").translate(TERM_BYTES).split()


def term_spans(text: str) -> list[tuple[int, int]]:
    """Character offsets of the words of ``terms`` in the original text."""
    return [m.span() for m in _TERM_ANY_CASE.finditer(text)]


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The given names, each changed until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def thinned(key: Column, share) -> Column:
    """True for about ``share`` of all keys, by hash: the same ones in each run."""
    return F.pmod(F.xxhash64(key, F.lit("thin")), F.lit(1 << 30)) < share * float(1 << 30)


def without(df: DataFrame, *names: str) -> list[Column]:
    """The columns of ``df`` but those of the given names (a result replaces a column of its name)."""
    gone = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in gone]


def add_columns(
    df: DataFrame, read: str, schema: str, build: Callable[[], Callable[[pa.Array], list[pa.Array]]]
) -> DataFrame:
    """Append columns that are computed from column ``read`` in Arrow batches.

    ``build`` runs once per task and returns the function of one string array
    (nulls included) to the arrays of the new columns, in the order of
    ``schema``. Columns of ``df`` that have a new column's name are replaced.
    Rows are streamed; nothing is kept from one batch to the next.
    """
    new = Ty._parse_datatype_string(schema)
    kept = df.select(*without(df, *new.names), F.col(f"`{read}`").cast("string").alias(fresh_names(df, "_read")[0]))
    out = Ty.StructType([*kept.schema.fields[:-1], *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = build()
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                made = compute(strings(part.column(part.num_columns - 1)))
                arrays = [*part.columns[:-1], *made]
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)
        del compute
        give_back()

    return kept.mapInArrow(run, out)


def strings(array: pa.Array) -> pa.Array:
    return array if pa.types.is_large_string(array.type) else array.cast(pa.large_string())


def slices(
    batch: pa.RecordBatch, column: int, bytes_at_once: int = 1 << 19, rows_at_once: int = 2048
) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``bytes_at_once`` of text and few rows, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes.astype(np.int64)) - sizes) // bytes_at_once
    cut = (np.diff(group) > 0) | (np.arange(1, batch.num_rows) % rows_at_once == 0)
    edges = [0, *(np.flatnonzero(cut) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offsets of its rows; null is empty."""
    array = strings(array)
    if array.null_count:
        array = pc.fill_null(array, "")
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray | None, inside: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Starts and ends (bytes) of all words, and for each row the number of words before it.

    ``is_word`` says which bytes stand in words; where that depends on their neighbours ``inside`` flags each byte instead.
    """
    inside = is_word[data] if inside is None else inside
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    edges = offsets[:-1][offsets[:-1] < len(data)]
    starts_at = inside & ~before
    starts_at[edges] = inside[edges]
    starts = np.flatnonzero(starts_at)
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends_at = inside & ~after
    last = offsets[1:][offsets[1:] > 0] - 1
    ends_at[last] = inside[last]
    return starts, np.flatnonzero(ends_at) + 1, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Which of the distinct byte strings each range is, and these strings.

    The ranges ascend and do not overlap. They are told apart by their bytes.
    """
    if not len(starts):
        return np.zeros(0, np.int64), []
    gaps = bool((starts[1:] != ends[:-1]).any())
    if gaps:  # what lies between two ranges is an entry too
        edges = np.empty(2 * len(starts), np.int64)
        edges[0::2], edges[1::2] = starts, ends
    else:
        edges = np.append(starts, ends[-1:]).astype(np.int64)
    parts = [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]
    known = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, parts).dictionary_encode()
    code, found = known.indices.to_numpy(), known.dictionary
    if gaps:
        code = code[0::2]
        used = np.zeros(len(found), bool)
        used[code] = True
        code, found = (np.cumsum(used) - 1)[code], found.filter(pa.array(used))
    return code, found.to_pylist()


class SpanHash:
    """64-bit hashes of many byte ranges: BLAKE2b of each distinct string, so that no texts with equal hashes can be made up."""

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        code, found = distinct_spans(data, starts, ends)
        digests = b"".join([blake2b(x, digest_size=8).digest() for x in found])
        return np.frombuffer(digests, np.uint64)[code]
