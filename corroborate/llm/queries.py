"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import prepare, table
from corroborate.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return build(spark, folder)

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


@query("op3_token_files")
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents in Arrow files, and what is read back from them."""
    import public_tokenizers

    from corroborate.llm.token_files import read_documents, write_tokens

    manifest = write_tokens(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))
    return read_documents(spark, manifest)


MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / coalesce(1 - 0.75::DOUBLE * (length(text) - length(translate(text, '#*$%&|<>', ''))) / greatest(length(text), 1), 1) AS k,
    coalesce(text, '') AS tie
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank
  FROM rows GROUP BY source),
weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS cap FROM sources),
levels AS (
  SELECT *, cap / w AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM weighed
  WINDOW o AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(level, (ratio, rank)) AS l FROM levels WHERE ratio >= level),
targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(l * w, cap)) AS target FROM levels, level),
placed AS (
  SELECT r.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
    coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY k, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * epochs + greatest(0, least(size, floor(target - epochs * source_size) - before)) AS BIGINT) AS taken
FROM placed
"""


@query("op4_mix_sources", MIX_SQL)
def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of each document."""
    from corroborate.llm.mixing import mix, text_weight, word_count

    docs = table(spark, folder, "documents")
    # Read and count the texts once; what follows works on a few numbers for each document.
    slim = cut_lineage(
        docs.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("words"),
            text_weight(F.col("text")).alias("weight"),
            F.xxhash64("text").alias("tie"),
        )
    )
    mixed = mix(slim, F.col("words"), F.col("weight"), tie=F.col("tie"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


LEAK_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, p.n, item FROM places p JOIN windows USING (n, s)),
covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""


@query("op5_benchmark_leaks", LEAK_SQL)
def op5_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """What each document shares with the benchmark."""
    from corroborate.llm.decontaminate import find_leaks, hit_count

    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, folder, "benchmark"))
    n_hit = hit_count("hit_words")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query("op7_near_duplicates")
def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class of each document: the smallest id in it; its own id if it has no words."""
    from corroborate.llm.neardup import near_duplicates

    classes = cut_lineage(near_duplicates(table(spark, folder, "documents")))
    named = classes.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return classes.join(named, "class", "left").select(
        "doc_id",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("class").isNull(), F.lit(1)).otherwise(F.col("class_size")).alias("class_size"),
    )


def id_hash(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base figures of each document and whether it is kept."""
    from corroborate.llm.quality_rules import judge, train

    docs = table(spark, folder, "documents")
    model = train(docs, table(spark, folder, "labels"))
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept probability".split()
    return judge(docs.select("doc_id", "text"), model).select(*columns)


@query("op10_quality_scores")
def op10_quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of each document; every fifth id (by hash) is held out of training."""
    from corroborate.llm.quality_model import score, train

    docs = table(spark, folder, "documents")
    model = train(docs, table(spark, folder, "labels"), allowed=id_hash("_id", 5) != 0)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (id_hash("doc_id", 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@query("op6_language")
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of each document; every third id (by hash) is held out of training."""
    from corroborate.llm.langid import identify, train

    docs = table(spark, folder, "documents")
    net = train(docs, allowed=id_hash("_id", 3) != 1)
    found = identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", (id_hash("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '</turn>', '<\/turn>') AS e,
    replace(replace(replace(replace(role, '\', '\\'), '<turn>', '<\turn>'), '</turn>', '<\/turn>'), chr(10), '\' || chr(10)) AS r
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, encode(role), encode(text))) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, encode(text)), '')) AS loss_sha256,
  CAST(sum(length(r) + length(e) + 15) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op8_chat_format", CHAT_SQL)
def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted texts."""
    from corroborate.llm.chat import format_turns, read_back

    said = "\\### Assistant: </turn> ok"
    columns = "conv_id bigint, turn bigint, role string, text string"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], columns)
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(rows.unionByName(probe)))


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licenses named in each document."""
    from corroborate.llm.licenses import scan_licenses

    found = scan_licenses(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


@query("op2_url_filter")
def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on each page's url."""
    from corroborate.llm.urls import judge_urls, train

    pages = table(spark, folder, "pages")
    judged = judge_urls(pages.select("page_id", "url"), train(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.array_join("words", " ").alias("words"))


@query("op11_resample")
def op11_resample(spark: SparkSession, folder: str) -> DataFrame:
    """Documents drawn for their likeness to the benchmark, with exact ranks."""
    from corroborate.llm.resample import resample

    found = resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_spelling")
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents, their near words and the forms they are variants of."""
    from corroborate.llm.spelling import group_variants

    found = group_variants(table(spark, folder, "documents"), typo_every=97)
    return found.select("word", "n", "n_near", "form", "form_n", "root")


@query("op12_packing")
def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 ids."""
    import public_tokenizers

    from corroborate.llm.packing import pack

    pieces = pack(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))
    columns = ["doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    return pieces.select(*columns)
