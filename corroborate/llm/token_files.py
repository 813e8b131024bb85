"""Token ids in Arrow files of equal-length sequences.

Each shard is two Arrow IPC files (the stream format between magic bytes, with
a footer of batch offsets):

* ``*.sequences.arrow``: ``ids`` (fixed_size_list of uint16 or uint32) and
  ``mask`` (fixed_size_list of bool, false on the padding of the last
  sequence). Every batch but the last has ``rows_per_batch`` sequences, so
  sequence i is row i % rows_per_batch of batch i // rows_per_batch, and a
  memory map gives it without a copy.
* ``*.documents.arrow``: ``doc_id``, ``first`` (position of its first id in
  the shard's ids) and ``n_tokens``.

Shards follow each other in ascending doc_id order. They are written to the
folder that all executors share, under a name of their own for each attempt;
only files named in the manifest count, so a lost executor's half-written
files are never read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.llm.common import distinct_spans, give_back, slices, strings, text_buffer
from corroborate.session import shared_folder

#: Text that is encoded together: the more, the fewer words are looked up.
BYTES_AT_ONCE = 1 << 21
MANIFEST = "shard int, documents bigint, tokens bigint, sequences_file string, documents_file string"
#: White space beside the ASCII kinds; texts with any of it are encoded whole.
_RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: First bytes of these characters in UTF-8.
_MAY_BE_RARE = np.array([0x1C <= b <= 0x1F or b in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])
#: One word of the tokenizer's first cut, whatever stands around it.
#: (Latin letters up to U+024F in UTF-8, after at most one space.)
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")
_SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
_ALNUM = np.array([chr(b).isalnum() and b < 0x80 for b in range(256)])
_STOP = np.array([chr(b) in ".,;:!?" for b in range(256)])


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where texts can be cut without a change of their tokens.

    The byte-level tokenizer cuts a text into words first and merges bytes only
    inside them: letters, digits or other characters, each with at most one
    space before them, or white space. So a word starts (1) at a white space
    character that follows another character; (2) at a space before another
    character; (3) behind a single white space character that is no space;
    (4) at a full stop or the like that follows a letter or digit. The end of
    a text counts as white space, since trailing white space is one word.
    """
    space, blank = _SPACE[data], data == 0x20
    first, last = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
    before, after = np.roll(space, 1), np.roll(space, -1)
    before[first], after[last] = False, True
    cut = (space & ~before) | (blank & ~after)
    lone = space & ~blank & ~before & ~after
    cut[1:] |= lone[:-1] | (_STOP[data[1:]] & _ALNUM[data[:-1]])
    cut[first] = True
    return np.flatnonzero(cut)


class WordCache:
    """Ids of whole texts, with the tokenizer run once for each distinct word.

    Words are told apart by their bytes. They are kept in two generations: a
    new word goes to the young one, a word met again is moved there, and once
    the young one has ``most`` words or ``most_bytes`` it becomes the old one.
    So frequent words stay and words met once go.
    """

    def __init__(self, tokenizer, dtype, most: int = 250_000, most_bytes: int = 1 << 24):
        self.tokenizer, self.dtype, self.most, self.most_bytes = tokenizer, np.dtype(dtype), most, most_bytes
        added = tokenizer.get_added_tokens_decoder().items()
        self.mark_id, self.mark = next((i, t.content) for i, t in added if t.special)
        self.alphabet = byte_alphabet()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string array."""
        data, offsets = text_buffer(texts)
        odd = np.concatenate(([0], np.cumsum(_MAY_BE_RARE[data])))[offsets]
        plain = np.ones(len(texts), bool)
        for i in np.flatnonzero(np.diff(odd)).tolist():
            plain[i] = not _RARE_SPACE.search(texts[i].as_py())
        starts = cut_points(data, offsets)
        ends = np.append(starts[1:], len(data))
        ids = np.zeros(0, self.dtype)
        edges = np.zeros(len(offsets), np.int64)
        if len(starts):
            word, words = distinct_spans(data, starts, ends)
            known = self.look_up(words)
            flat = np.frombuffer(b"".join(known), self.dtype)
            width = np.array([len(x) for x in known], np.int64) // self.dtype.itemsize
            first, sizes = np.cumsum(width) - width, width[word]
            upto = np.concatenate(([0], np.cumsum(sizes)))
            ids = flat[np.repeat(first[word] - upto[:-1], sizes) + np.arange(upto[-1])]
            edges = upto[np.searchsorted(starts, offsets)]
        return [
            ids[a:b] if ok else np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype)
            for i, (a, b, ok) in enumerate(zip(edges[:-1], edges[1:], plain))
        ]

    def look_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as bytes."""
        found = list(map(self.young.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        moved = [words[i] for i in new]
        known = list(map(self.old.get, moved))
        made = iter(self.fresh([w for w, ids in zip(moved, known) if ids is None]))
        known = [next(made) if ids is None else ids for ids in known]
        for i, ids in zip(new, known):
            found[i] = ids
        self.young.update(zip(moved, known))
        self.held += sum(map(len, moved)) + sum(map(len, known))
        if len(self.young) > self.most or self.held > self.most_bytes:
            self.old, self.young, self.held = self.young if self.held <= self.most_bytes else {}, {}, 0
        return found

    def fresh(self, words: list[bytes]) -> list[bytes]:
        """Ids of many short texts.

        Plain letters are one word, which the tokenizer's model takes as it is
        (bytes in its own alphabet). The others are encoded in one call, with a
        special token between them that keeps them apart.
        """
        alphabet, tokenize, letters, blank = self.alphabet, self.tokenizer.model.tokenize, _LETTERS.fullmatch, self.alphabet[0x20]
        out: list[list[int]] = []
        others: list[tuple[int, str]] = []
        for word in words:
            if word[0] == 0x20 and word[1:].isalpha():
                out.append([t.id for t in tokenize(blank + word[1:].decode("ascii"))])
                continue
            if letters(word):
                out.append([t.id for t in tokenize(word.decode("latin-1").translate(alphabet))])
                continue
            text = word.decode()
            if self.mark in text:
                out.append(self.tokenizer.encode(text, add_special_tokens=False).ids)
            else:
                others.append((len(out), text))
                out.append([])
        for i in range(0, len(others), 4096):
            some = others[i : i + 4096]
            joined = self.mark.join([text for _, text in some])
            self.tokenizer.encode_special_tokens = False  # only here the mark is a token
            (found,) = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)
            self.tokenizer.encode_special_tokens = True
            at = 0
            for token in found.ids:
                if token == self.mark_id:
                    at += 1
                else:
                    out[some[at][0]].append(token)
        sizes = [len(x) * self.dtype.itemsize for x in out]
        flat = np.fromiter(chain.from_iterable(out), self.dtype, sum(map(len, out))).tobytes()
        return [flat[end - size : end] for size, end in zip(sizes, accumulate(sizes))]


def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def worker_cache(path: str, dtype: str) -> WordCache:
    """The word cache of this Python worker. Workers serve many tasks, so it is kept on the library's module."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_word_caches", {})
    if (path, dtype) not in kept:
        kept[path, dtype] = WordCache(load_tokenizer(path), dtype)
    return kept[path, dtype]


class ShardWriter:
    """Writes one shard; holds at most one batch of sequences and of documents."""

    def __init__(self, folder: str, shard: int, length: int, rows_per_batch: int, dtype, doc_id: pa.DataType):
        self.files, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}"
        self.paths = (f"{name}.sequences.arrow", f"{name}.documents.arrow")
        self.length, self.rows, self.dtype = length, rows_per_batch, np.dtype(dtype)
        self.ids_type = pa.list_(pa.from_numpy_dtype(self.dtype), length)
        self.mask_type = pa.list_(pa.bool_(), length)
        self.doc_schema = pa.schema([("doc_id", doc_id), ("first", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.files.open_output_stream(p) for p in self.paths]
        self.sequences = pa.ipc.new_file(self.sinks[0], pa.schema([("ids", self.ids_type), ("mask", self.mask_type)]))
        self.docs = pa.ipc.new_file(self.sinks[1], self.doc_schema)
        self.buffer = np.empty(length * rows_per_batch, self.dtype)
        self.filled = self.tokens = self.documents = 0

    def add(self, doc_ids: pa.Array, rows: list[np.ndarray]) -> None:
        sizes = np.array([len(r) for r in rows], np.int64)
        first = self.tokens + np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(rows) else sizes
        self.docs.write_batch(pa.record_batch([doc_ids, pa.array(first), pa.array(sizes)], schema=self.doc_schema))
        self.documents += len(rows)
        for row in rows:
            self.tokens += len(row)
            while len(row):
                n = min(len(row), len(self.buffer) - self.filled)
                self.buffer[self.filled : self.filled + n] = row[:n]
                self.filled += n
                row = row[n:]
                if self.filled == len(self.buffer):
                    self.flush()

    def flush(self) -> None:
        count = -(-self.filled // self.length)
        if not count:
            return
        ids, used = self.buffer[: count * self.length].copy(), self.filled
        ids[used:] = 0
        mask = np.arange(len(ids)) < used
        self.sequences.write_batch(
            pa.record_batch(
                [
                    pa.FixedSizeListArray.from_arrays(pa.array(ids), type=self.ids_type),
                    pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.mask_type),
                ],
                names=["ids", "mask"],
            )
        )
        self.filled = 0

    def close(self) -> None:
        self.flush()
        for x in (self.sequences, self.docs, *self.sinks):
            x.close()


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    end_id: int = 2,
    length: int = 2048,
    rows_per_batch: int = 64,
    shards: int | None = None,
) -> DataFrame:
    """Encode whole texts into shards and return the manifest, one row for each shard.

    Documents are dealt to shards by ranges of (doc_id, hash of the text) and
    sorted inside them; null ids come first. A null text is empty: its only id
    is the end id. Repeated ids stay in the order of their texts' hashes, and
    rows that are equal in all stay next to each other. An empty table gives
    an empty manifest. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)
    probe = load_tokenizer(tokenizer_path)
    dtype = "uint16" if max(probe.get_vocab_size(), end_id + 1) <= 1 << 16 else "uint32"
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).withColumn("_hash", F.xxhash64("text"))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(shards, "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back()  # what earlier steps left in this worker
        words, writer, shard = None, None, TaskContext.get().partitionId()
        end = np.array([end_id], dtype)
        for batch in batches:
            for part in slices(batch, 1, BYTES_AT_ONCE):
                if writer is None:
                    words = worker_cache(tokenizer_path, dtype)
                    writer = ShardWriter(folder, shard, length, rows_per_batch, dtype, part.schema.field(0).type)
                found = words.encode(strings(part.column(1)))
                writer.add(part.column(0), [np.concatenate((ids, end)) for ids in found])
        if writer is not None:
            writer.close()
            give_back()
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "documents": pa.array([writer.documents], pa.int64()),
                    "tokens": pa.array([writer.tokens], pa.int64()),
                    "sequences_file": [writer.paths[0]],
                    "documents_file": [writer.paths[1]],
                }
            )

    path = f"{folder}/manifest.parquet"
    placed.mapInArrow(write, MANIFEST).write.parquet(path)
    return spark.read.parquet(path)


class ShardReader:
    """Random access to a shard's sequences and documents."""

    def __init__(self, files: fs.FileSystem, sequences: str, documents: str):
        self.files = files
        self.sequences, self.docs = self.open(sequences), self.open(documents)
        first = self.sequences.get_batch(0) if self.sequences.num_record_batches else None
        self.rows = first.num_rows if first is not None else 0
        self.length = self.sequences.schema.field("ids").type.list_size

    def open(self, path: str) -> pa.ipc.RecordBatchFileReader:
        local = isinstance(self.files, fs.LocalFileSystem)
        return pa.ipc.open_file(pa.memory_map(path) if local else self.files.open_input_file(path))

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``; the ids are a view of the file where it is mapped."""
        batch = self.sequences.get_batch(i // self.rows)
        row = i % self.rows
        ids, mask = batch.column(0), batch.column(1)
        return (
            ids.flatten().to_numpy()[row * self.length : (row + 1) * self.length],
            mask.flatten().to_numpy(zero_copy_only=False)[row * self.length : (row + 1) * self.length],
        )

    def documents(self) -> Iterator[pa.RecordBatch]:
        for i in range(self.docs.num_record_batches):
            yield self.docs.get_batch(i)

    def tokens(self, first: int, n: int) -> Iterator[np.ndarray]:
        """Ids ``first`` to ``first + n`` of the shard, in views of at most a batch."""
        size = self.rows * self.length
        while n > 0:
            ids = self.sequences.get_batch(first // size).column(0).flatten().to_numpy()
            part = ids[first % size : first % size + n]
            yield part
            first, n = first + len(part), n - len(part)


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row for each document, from the files: doc_id, start, n_tokens, ids_crc32, shard.

    ``start`` is the number of ids of all documents before it, over all
    shards. The prefix sum over shards runs over the manifest, one row for
    each shard (about one for each 100 MB of text).
    """
    folder_of = F.regexp_extract(F.input_file_name(), "^([a-z0-9]+:/+)", 1)
    scheme = manifest.select(folder_of.alias("s")).first()
    base = scheme["s"] if scheme else "file:/"
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("_base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = shards.select("shard", "sequences_file", "documents_file", "_base").repartition(parts, "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files = fs.LocalFileSystem() if base.startswith("file:") else fs.FileSystem.from_uri(base)[0]
                reader = ShardReader(files, row["sequences_file"], row["documents_file"])
                for found in reader.documents():
                    crcs = []
                    for first, n in zip(found.column(1).to_pylist(), found.column(2).to_pylist()):
                        crc = 0
                        for part in reader.tokens(first, n):
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": found.column(0).cast(pa.int64()),
                            "start": pa.array(found.column(1).to_numpy() + row["_base"]),
                            "n_tokens": found.column(2),
                            "ids_crc32": pa.array(crcs, pa.int64()),
                            "shard": pa.array([row["shard"]] * len(crcs), pa.int32()),
                        }
                    )

    return dealt.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard int")
