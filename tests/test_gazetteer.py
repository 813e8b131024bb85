"""Gazetteer tables of any size against a search for each alias."""

import random

from pyspark.sql import functions as F

from corroborate.functions import places as P
from corroborate.operators import gazetteer as G

TABLE = "node string, level string, parent string, aliases array<string>"


def above_one_by_one(rows):
    parent = {r[0]: r[2] for r in rows}
    out = {}
    for node in parent:
        chain, at = [], node
        while at is not None and at not in chain:
            chain.append(at)
            at = parent.get(at)
        out[node] = chain
    return out


def test_closure_of_the_literal_places(spark):
    got = {(r.place, r.within) for r in G.containment(G.gazetteer_of(spark)).collect()}
    assert got == {(r.place, r.within) for r in P.place_closure(spark).collect()}


def test_ten_thousand_places_one_by_one(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(10_000):
        parent = f"p{rng.randrange(i)}" if i and rng.random() < 0.9 else None
        aliases = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(rng.choice([0, 1, 2]))]
        rows.append((f"p{i}", "city", parent, aliases))
    rows += [("loop1", "city", "loop2", ["round"]), ("loop2", "city", "loop1", ["about"])]
    table = spark.createDataFrame(rows, TABLE)
    chains = above_one_by_one(rows)
    got = {}
    for r in G.containment(table).collect():
        got.setdefault(r.place, []).append((r.distance, r.within))
    assert {k: [w for _, w in sorted(v)] for k, v in got.items()} == chains
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "Round, ABOUT!"), (None, "w1"), (103, "w5 " * 500)]
    expected = set()
    for i, t in texts:
        if i is None or not t:
            continue
        padded = " " + " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) + " "
        found = {r[0] for r in rows if any(f" {a} " in padded for a in r[3])}
        inner = {w for n in found for w in chains[n][1:]}
        expected |= {(i, n) for n in found - inner}
    frame = spark.createDataFrame(texts, "id bigint, text string")
    named = G.named_places(frame, table, "id", F.col("text"))
    assert {tuple(r) for r in named.collect()} == expected and len(expected) > 100
    assert G.named_places(frame, table.filter("false"), "id", F.col("text")).count() == 0
    assert G.named_places(frame.filter("false"), table, "id", F.col("text")).count() == 0


def test_a_text_of_many_words_costs_its_words(spark):
    # With a copy of the text for each of its words, 200,000 copies of 200,000 words would be made.
    table = spark.createDataFrame([("a", "city", None, ["end of it", "w1 w2"]), ("b", "city", None, ["w39999"])], TABLE)
    long = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(199_999)), lambda i: F.concat(F.lit("w"), i % 40_000)))
    named = G.named_places(spark.range(4).select("id", F.concat(long, F.lit(", End of IT")).alias("t")), table, "id", F.col("t"))
    assert {tuple(r) for r in named.collect()} == {(i, n) for i in range(4) for n in "ab"}
