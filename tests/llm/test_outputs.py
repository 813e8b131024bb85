"""Token files, mixing, near-duplicates, chat formatting and the pipeline against one-by-one versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

import corpus_pipeline
from corroborate.llm import chat, mixing, neardup, template
from corroborate.llm.bagminhash import Shingler, overlap, weigh
from corroborate.llm.common import prepare
from corroborate.llm.quality_rules import fit, judge
from corroborate.llm.token_files import ShardReader, WordCache, load_tokenizer, read_documents, write_tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return load_tokenizer(TOKENIZER)


def test_word_cache_gives_the_tokenizers_ids(tokenizer):
    rng = random.Random(1)
    signs = [" ", " ", "\n", "\t", "a", "Bc", "é", ".", ",", "'s", "1", "»", "　", "\x1c", "<|endoftext|>", "語"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    cache = WordCache(tokenizer, "uint16", most=2000)  # small, so that it is cleared on the way
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for text, ids in zip(part, cache.encode(pa.array(part, pa.large_string()))):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_word_cache_tells_long_words_apart_by_their_bytes(tokenizer):
    for n in (1024, 2048):
        one, two = ("".join(pair[i.bit_count() % 2] for i in range(n)) for pair in ("ab", "ba"))
        cache = WordCache(tokenizer, "uint16", most_bytes=5000)
        for text in (f"x {one}", f"x {two}", f"x {one} {two}"):
            (ids,) = cache.encode(pa.array([text], pa.large_string()))
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, odd_docs, no_docs, tokenizer, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    manifest = write_tokens(docs.withColumn("shard", F.lit(1)), TOKENIZER, folder=str(tmp_path / "t"), length=128, rows_per_batch=4, shards=3)
    found = read_documents(spark, manifest).collect()
    ids = {(r["doc_id"], r["text"]): [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    expected = sorted((i if i is not None else -1, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in ids.items())
    got = sorted({(r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_crc32"]) for r in found})
    assert got == expected and len(found) == docs.count()
    start = 0
    order = sorted(found, key=lambda r: r["start"])
    for row in order:
        assert row["start"] == start
        start += row["n_tokens"]
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in order]
    assert keys == sorted(keys)
    shard = manifest.orderBy("shard").first()
    reader = ShardReader(fs.LocalFileSystem(), shard["sequences_file"], shard["documents_file"])
    last = (shard["tokens"] - 1) // 128
    values, mask = reader.sequence(last)
    assert len(values) == 128 and mask.sum() == shard["tokens"] - 128 * last and values[mask][-1] == 2
    assert not values.flags.owndata
    assert read_documents(spark, write_tokens(no_docs, TOKENIZER, folder=str(tmp_path / "e"))).count() == 0


def one_by_one_targets(sizes, weights=(5, 2, 1), most=3):
    """Reshare the excess until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        target = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return {**capped, **target}
        capped.update({s: most * sizes[s] for s in over})


def test_mix(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hot = F.when(F.col("doc_id") % 3 == 0, F.lit("src0")).otherwise(F.col("source"))
    docs = docs.withColumn("source", hot).unionByName(odd_docs.select(*docs.columns)).withColumns({c: F.lit("mine") for c in ("taken", "_key", "_words", "_row", "_source")})
    text = F.col("text")
    runs = [mixing.mix(docs, mixing.word_count(text), mixing.text_weight(text), tie=F.xxhash64(text), blocks=b) for b in (4, 40)]
    keys = ("doc_id", "size", "source_size", "target", "taken")
    rows, again = (sorted((tuple(r[k] for k in keys) for r in run.collect()), key=repr) for run in runs)
    assert rows == again  # blocks change nothing
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in runs[0].collect():
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    expected = one_by_one_targets(sizes)
    for source in sizes:
        assert abs(target[source] - expected[source]) < 1e-6 * max(1, expected[source])
        assert target[source] - 1 <= taken[source] <= target[source]
    copies = mixing.repeat_taken(runs[0], n_chars="n_chars")
    assert copies.select(F.sum(mixing.word_count(text))).first()[0] == sum(taken.values())
    assert mixing.mix(no_docs, mixing.word_count(text), mixing.text_weight(text)).count() == 0


def test_heavier_documents_come_first(spark):
    """Efraimidis-Spirakis: the heavier a document the earlier it is drawn."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 2).alias("heavy"))
    weight = F.when(F.col("heavy") == 1, 1.0).otherwise(0.25)
    mixed = mixing.mix(docs, F.lit(1).cast("bigint"), weight, share=0.5)
    got = {r["heavy"]: r["n"] for r in mixed.groupBy("heavy").agg(F.sum("taken").alias("n")).collect()}
    assert got[0] + got[1] == 2000 and got[1] > 1.8 * got[0]


def classes_one_by_one(rows, threshold=0.8):
    bags = [weigh(x) for x in Shingler()(pa.array([t for _, t in rows], pa.large_string()))]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n, m = bags[i][1].sum(), bags[j][1].sum()
            if n and min(n, m) >= threshold * max(n, m) and overlap(bags[i], bags[j]) >= threshold:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))]


def near_rows():
    """A chain of edits, copies, a group around a centre, short texts, and awkward rows."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    chain = [rng.choice(words) for _ in range(200)]
    rows, n = [], 100
    for _ in range(12):
        chain = list(chain)
        chain[rng.randrange(len(chain))] = rng.choice(words)
        rows.append((n, " ".join(chain)))
        n += 1
    base = [rng.choice(words) for _ in range(300)]
    for _ in range(40):
        edited = list(base)
        for _ in range(rng.randrange(0, 7)):
            edited[rng.randrange(300)] = rng.choice(words)
        rows.append((n, " ".join(edited)))
        n += 1
    rows += [(n + i, " ".join(base[:150]) + f" x{i} " * 60) for i in range(6)]
    return rows + [(n + 10, "a b c"), (n + 11, "A, b: c!"), (n + 12, "a b d"), (n + 13, ""), (n + 14, None), (n + 15, "...")]


def test_near_duplicates_one_by_one(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + near_rows() + [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    made = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("content", F.lit("mine"))
    found = neardup.near_duplicates(made).collect()
    assert len(found) == len(rows)
    expected = classes_one_by_one(rows)
    groups, got = defaultdict(list), defaultdict(list)
    for (doc_id, text), root in zip(rows, expected):
        if any(c.isalnum() for c in text or ""):
            groups[root].append(repr(doc_id))
    for r in found:
        if r["class"] is not None:
            got[bytes(r["class"])].append(repr(r["doc_id"]))
    assert sorted(sorted(g) for g in groups.values()) == sorted(sorted(g) for g in got.values())
    kept = neardup.keep_one(made)
    assert kept.columns == made.columns
    wordless = sum(not any(c.isalnum() for c in t or "") for _, t in rows)
    assert kept.count() == len(groups) + wordless


@pytest.mark.parametrize("most_edits", [6, 12, 25])
def test_a_large_group_of_edited_copies_gives_few_pairs(spark, monkeypatch, most_edits):
    """Members far from each other meet in many buckets; what they lack in common keeps them apart without comparison."""
    rng = random.Random(most_edits)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(300)]
    rows = []
    for n in range(400):
        edited = list(base[: rng.choice([300, 300, 300, 240, 200])])
        for _ in range(rng.randint(1, most_edits)):
            edited[rng.randrange(len(edited))] = rng.choice(words)
        if n % 10 == 0:  # a family of its own inside the group
            edited[100:130] = [f"own{i}" for i in range(30)]
        rows.append((n, " ".join(edited)))
    numbers, meet = [], neardup._meet

    def counted(pairs, *options):
        numbers.append(pairs.count())
        return meet(pairs, *options)

    monkeypatch.setattr(neardup, "_meet", counted)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = defaultdict(list)
    for r in found:
        got[bytes(r["class"])].append(r["doc_id"])
    expected = defaultdict(list)
    for (n, _), root in zip(rows, classes_one_by_one(rows)):
        expected[root].append(n)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))
    assert numbers[-1] < len(rows)  # pairs compared one by one after the rounds with hubs


def test_numbered_multisets_share_what_multisets_share():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (weigh(rng.integers(0, 9, rng.integers(1, 30)).astype(np.uint64)) for _ in range(2))
        x, y = set(neardup.numbered(a).tolist()), set(neardup.numbered(b).tolist())
        assert len(x) == a[1].sum() and abs(overlap(a, b) - len(x & y) / len(x | y)) < 1e-12


def test_near_duplicates_of_nothing(no_docs):
    assert neardup.near_duplicates(no_docs).count() == 0


def test_bands_miss_few():
    assert neardup.misses(0.8) < 1e-4


def test_template_folding_and_sandbox():
    folded = template.fold(template.parse("a{{ 'b' ~ (1 + 2) }}{% if true %}c{% else %}d{% endif %}{# no #}{{ 'e' | upper }}"))
    assert folded == [template.Write(template.Literal("ab3cE"))]
    kept = template.fold(template.parse("{% if x %}a{% elif 1 == 2 %}b{% else %}c{% endif %}"))
    assert [c for c, _ in kept[0].cases] == [template.Name("x"), template.Literal(True)]
    with pytest.raises(template.TemplateError):
        template.Template("{% for m in messages %}{{ m.text.__class__() }}{% endfor %}")
    with pytest.raises(template.TemplateError):
        template.Template("{% for m in messages %}{{ m.text | nothing }}{% endfor %}")
    with pytest.raises(template.TemplateError):
        template.Template("no loop")
    out = template.Template("{% for m in messages %}{{ m.text.__class__ }}{% endfor %}")
    assert list(out.render(iter([{"text": "x"}]))) == [("", [])]


def test_template_statements():
    source = (
        "<s>{% set n = 'N' %}{% for m in messages -%}  {{ loop.index }}{{ n if loop.first else '-' }}"
        "{% if m.role == 'a' or m.role in 'bc' %}{% generation %}{{ m['text'] | upper }}{% endgeneration %}"
        "{% elif not m.text %}none{% else %}{{ m.text }}{% endif %}{{ '!' if loop.last }}{% endfor %}</s>"
    )
    rows = [{"role": "a", "text": "x"}, {"role": "z", "text": None}, {"role": "b", "text": "yz"}]
    pieces = list(template.Template(source).render(iter(rows)))
    assert pieces == [("<s>1NX", [(5, 6)]), ("2-none", []), ("3-YZ!</s>", [(2, 4)])]


def test_escape_is_reversible():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["\\", "<turn>", "</turn>", "<", "/", "turn>", "\n", "é", "x"]) for _ in range(rng.randint(0, 9)))
        escaped = template.escape(text)
        assert template.unescape(escaped) == text and template.unescape(template.escape_line(text)) == text
        assert not any(control in escaped for control in template.CONTROLS)


def test_conversations_read_back(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    rows += [(None, 0, "user", "x"), (None, 1, None, None), (-1, None, "assistant", "</turn>\\"), (-1, 0, "us\ner<turn>", "\\### Assistant: </turn> ok")]
    rows += [(-2, 0, "assistant", "again"), (-2, 0, "assistant", "again")]
    made = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("place", F.lit("mine"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(made)).collect()}
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode(), role or "", text or ""))
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t[5] for t in turns if t[4] == "assistant")
        digest = hashlib.sha256("".join(f"{t[4]}\n{t[5]}\n" for t in turns).encode()).hexdigest()
        row = got[conv]
        assert (row["n_turns"], row["turns_sha256"]) == (len(turns), digest)
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(made.filter("false"))).count() == 0


def test_pipeline_stages_one_by_one(spark, tokenizer):
    """Each stage of the pipeline against plain Python on its own input."""
    from corroborate.llm.quality_rules import judge, train
    from test_scans import brute_leaks

    made, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    columns = list(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        made.append(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    start = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(start, spark.read.parquet(f"{SF}/labels.parquet"))
    judged = judge(start, model).filter("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words and probability >= 0.2")
    assert sorted(r["doc_id"] for r in made[0]) == sorted(r["doc_id"] for r in judged.collect())
    pairs = sorted((r["doc_id"], r["text"]) for r in made[0])
    roots = classes_one_by_one(pairs)
    assert sorted(r["doc_id"] for r in made[1]) == sorted({pairs[root][0] for root in roots})
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r["doc_id"] for r in made[1] if not brute_leaks(r["text"], items)[1]]
    assert sorted(r["doc_id"] for r in made[2]) == sorted(clean)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in made[2]:
        sizes[r["source"]] += len(r["text"].split())
    for r in made[3]:
        taken[r["source"]] += len(r["text"].split())
    for source, target in one_by_one_targets(sizes).items():
        assert target - 1 <= taken[source] <= target + 1e-6
    written = sorted(
        (r["doc_id"], zlib.crc32(np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in made[3]
    )
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in made[4]) == written
    assert all(list(r.asDict()) == columns for rows in made[:4] for r in rows[:1])


def test_texts_come_to_workers_in_small_batches(spark):
    """Memory of a worker and of Arrow's buffers grows with the rows that are sent at once."""
    prepare(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    found = [r["n"] for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n bigint").collect()]
    assert sum(found) == 5000 and max(found) <= 2000


def test_small_batches_give_the_same_rows(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 97}" for k in range(i % 120))) for i in range(900)], "doc_id bigint, text string")
    got = []
    for rows in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        figures = judge(docs, fit([f"{('w2 w3', 'w4 w5')[i % 2]} w{i}" for i in range(40)], np.arange(40) % 2)).drop("text")
        read = read_documents(spark, write_tokens(docs, TOKENIZER, shards=2)).drop("shard")
        got.append((sorted(map(tuple, figures.collect())), sorted(map(tuple, read.collect()))))
    prepare(spark)
    assert got[0] == got[1]
