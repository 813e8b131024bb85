"""Conversations written with a compiled template, message by message.

Rows of a conversation meet in one task in the order of their turns and are
streamed: a task holds one message (and the next), whatever the length of the
conversation. The result has one row for each message: its piece of the
conversation's text and the spans a model is to learn from.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.llm.template import Template, unescape

#: Marks turns; only what an assistant says is learned.
TURNS = """\
{%- for message in messages -%}
<turn>{{ message.role | escape_line }}{{ '\\n' }}
{%- if message.role == 'assistant' -%}
{% generation %}{{ message.text | escape }}{% endgeneration %}
{%- else -%}
{{ message.text | escape }}
{%- endif -%}
</turn>{{ '\\n' }}
{%- endfor -%}
"""
_PIECE = re.compile(r"<turn>((?:\\.|[^\\\n])*)\n(.*)</turn>\n", re.DOTALL)
PIECES = "conv_id bigint, place bigint, piece string, loss array<struct<start:bigint,end:bigint>>"


def in_order(conversations: DataFrame) -> DataFrame:
    """Messages of a conversation together, ordered by turn (null first), role and text."""
    columns = [
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ]
    return conversations.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def in_batches(rows: Iterator[dict], schema: pa.Schema, characters: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about so many characters of strings."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += 64 + sum(len(v) for v in row.values() if isinstance(v, str))
        if size >= characters:
            yield pa.RecordBatch.from_pylist(kept, schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema)


def format_turns(conversations: DataFrame, template: str = TURNS) -> DataFrame:
    """One row for each message: conv_id, its place from 0, its piece of the text, and the spans to learn.

    The pieces of a conversation, in order, are its text; spans are offsets in
    the piece, in code points, end exclusive. A null text or role is empty; a
    null conv_id is one conversation; messages of one turn, repeated rows
    among them, are all kept in the order of role and text. An empty table
    gives an empty result. Other columns are not read.
    """
    Template(template)  # errors show here, not in a task
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("piece", pa.string()), ("loss", spans)])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)

        def pieces():
            for conversation, messages in groupby(rows_of(batches), key=lambda r: r["conv_id"]):
                for place, (piece, loss) in enumerate(compiled.render(iter(messages))):
                    marks = [{"start": a, "end": b} for a, b in loss]
                    yield {"conv_id": conversation, "place": place, "piece": piece, "loss": marks}

        yield from in_batches(pieces(), schema)

    return in_order(conversations).mapInArrow(write, PIECES)


def read_piece(piece: str) -> tuple[str, str]:
    """Role and text of a piece that was written with ``TURNS``."""
    found = _PIECE.fullmatch(piece)
    if found is None:
        raise ValueError(f"not a turn: {piece[:80]!r}")
    return unescape(found[1]), unescape(found[2])


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, from the rows of ``format_turns`` with ``TURNS`` as they come."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
         ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations():
            for conversation, rows in groupby(rows_of(batches), key=lambda r: r["conv_id"]):
                turns, loss, n, learned, length = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for row in rows:
                    role, text = read_piece(row["piece"])
                    turns.update(f"{role}\n{text}\n".encode())
                    for span in row["loss"]:
                        part = unescape(row["piece"][span["start"] : span["end"]])
                        loss.update(part.encode())
                        learned += len(part)
                    n += 1
                    length += len(row["piece"])
                yield {
                    "conv_id": conversation, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": learned,
                    "loss_sha256": loss.hexdigest(), "formatted_chars": length,
                }

        yield from in_batches(conversations(), schema)

    return pieces.mapInArrow(
        digest,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
