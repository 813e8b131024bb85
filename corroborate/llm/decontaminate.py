"""Benchmark decontamination with one Aho-Corasick automaton over word numbers.

Benchmark texts are normalised to words. Each run of ``window`` consecutive
words of an item is a pattern (an item with fewer words is one pattern). The
automaton's letters are the numbers of the benchmark's distinct words, so that
it has one state for each word of a pattern, and a document is scanned once
whatever the number of patterns. Hits are mapped back to character offsets of
the original text.

Size of what is sent to the tasks: the benchmark is dealt to shards of at most
``max_words`` words, counted before anything is collected. Almost every
benchmark is one shard. With more, each shard is one pass over the documents
that carries on the hits of the pass before, so memory never grows with the
benchmark. An item that alone has more words is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.llm.common import add_columns, fresh_names, term_spans, terms
from corroborate.session import cut_lineage

HITS = "n_words bigint, hit_words array<struct<first:bigint,last:bigint>>, item_ids array<string>, spans array<struct<first:bigint,last:bigint>>"


class Automaton:
    """Patterns of one shard. Scanning gives covered word ranges and the items found."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], list[str]] = {}
        for item, words in items:
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words)
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners = found.setdefault(ids[i : i + window], [])
                if not owners or owners[-1] != item:
                    owners.append(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, owners in found.items():
            self.machine.add_word(pattern, (len(pattern), owners))
        self.empty = not found
        if found:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        ranges: list[list[int]] = []
        items: set[str] = set()
        if self.empty or not words:
            return ranges, items
        number = self.numbers.get
        for last, (length, owners) in self.machine.iter(tuple([number(w, 0) for w in words])):
            items.update(owners)
            ranges.append([last - length + 1, last])
        return merge(ranges), items


def merge(ranges: Iterable[list[int]]) -> list[list[int]]:
    """Inclusive ranges, sorted, those that touch or overlap joined."""
    out: list[list[int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_text: str = "text",
    item_id: str = "item_id",
    window: int = 10,
    max_words: int = 2_000_000,
) -> DataFrame:
    """All rows of ``docs`` with what the benchmark shares with them.

    Adds ``n_words``; ``hit_words``, the ranges of words inside any window of
    the benchmark (from 0, inclusive, merged); ``spans``, the same ranges as
    character offsets of the original text (end exclusive); and ``item_ids``,
    the distinct items with a window in the text, as sorted strings. Columns
    of ``docs`` that have one of these names are replaced.

    A null or empty text and an empty benchmark give no hits and empty lists.
    An item without words matches nothing; a null item id counts as "". Items
    with the same id count once; repeated document rows are judged each on its
    own.
    """
    sized = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("words"),
    )
    # A word takes two characters at least, its separator included.
    total = sized.agg(F.sum((F.length("words") + 1) / 2)).first()[0] or 0
    shards = max(1, -(-int(total) // max_words))
    out, carried = docs, None
    for shard in range(shards):
        mine = sized.filter(F.pmod(F.xxhash64("item", "words"), F.lit(shards)) == shard)
        rows = [(r["item"], terms(r["words"])) for r in mine.collect()]
        sent = docs.sparkSession.sparkContext.broadcast(rows)
        if shard:
            before = fresh_names(docs, "_before")[0]
            out = cut_lineage(out).withColumn(before, F.struct("hit_words", "item_ids"))
            carried = before
        out = _pass(out, text, sent, window, carried)
    return out


def _pass(docs: DataFrame, text: str, sent, window: int, carried: str | None) -> DataFrame:
    found = add_columns(docs, text, HITS, _scanner(sent, window))
    if carried is None:
        return found
    # Later shards: join what was found before with what this pass found.
    spans = fresh_names(found, "_found")[0]
    both = found.withColumn(spans, F.concat("hit_words", F.col(f"{carried}.hit_words")))
    ids = F.array_sort(F.array_union("item_ids", F.col(f"{carried}.item_ids")))
    both = both.withColumn("item_ids", ids)
    (joined,) = fresh_names(both, "_joined")
    return add_columns(
        both.withColumn(joined, F.to_json(F.struct(F.col(text).alias("t"), F.col(spans).alias("r")))),
        joined,
        "hit_words array<struct<first:bigint,last:bigint>>, spans array<struct<first:bigint,last:bigint>>",
        _joiner,
    ).select(*[c for c in [*docs.columns] if c != carried and c not in ("n_words", "hit_words", "item_ids", "spans")],
             "n_words", "hit_words", "item_ids", "spans")


def _ranges(rows: list[list[list[int]]]) -> pa.Array:
    pairs = pa.struct([("first", pa.int64()), ("last", pa.int64())])
    return pa.array([[{"first": a, "last": b} for a, b in row] for row in rows], pa.list_(pairs))


def _spans(text: str, ranges: list[list[int]]) -> list[list[int]]:
    if not ranges:
        return []
    at = term_spans(text)
    return [[at[a][0], at[b][1]] for a, b in ranges]


def _scanner(sent, window: int) -> Callable:
    def build():
        machine = Automaton(sent.value, window)

        def compute(texts: pa.Array) -> list[pa.Array]:
            counts, ranges, items, spans = [], [], [], []
            for text in texts.to_pylist():
                words = terms(text or "")
                covered, found = machine.scan(words)
                counts.append(len(words))
                ranges.append(covered)
                items.append(sorted(found))
                spans.append(_spans(text or "", covered))
            return [pa.array(counts, pa.int64()), _ranges(ranges), pa.array(items, pa.list_(pa.string())), _ranges(spans)]

        return compute

    return build


def _joiner():
    import json

    def compute(rows: pa.Array) -> list[pa.Array]:
        ranges, spans = [], []
        for row in map(json.loads, rows.to_pylist()):
            joined = merge([r["first"], r["last"]] for r in row["r"])
            ranges.append(joined)
            spans.append(_spans(row.get("t") or "", joined))
        return [_ranges(ranges), _ranges(spans)]

    return compute


def hit_count(ranges="hit_words"):
    """Number of words in the covered ranges."""
    return F.aggregate(ranges, F.lit(0).cast("bigint"), lambda n, r: n + r["last"] - r["first"] + 1)
