"""From raw documents to token files: five stages over tables in the shared folder.

Every stage works on all rows that the one before kept. All stages but the
last return the columns of documents; the last returns one row for each
written document. Null and empty texts fail the quality rules. Empty tables
pass through every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import prepare, table
from corroborate.llm.decontaminate import find_leaks
from corroborate.llm.mixing import mix, repeat_taken, text_weight, word_count
from corroborate.llm.neardup import keep_one
from corroborate.llm.quality_rules import judge, train
from corroborate.llm.token_files import read_documents, write_tokens
from corroborate.session import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the trained model rejects go."""
    prepare(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    return judge(docs, model).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    prepare(spark)
    return keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go."""
    prepare(spark)
    found = find_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hit_words") == 0).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    mixed = mix(docs.select(*COLUMNS), word_count(F.col("text")), text_weight(F.col("text")), tie=F.xxhash64("text"))
    return repeat_taken(mixed, n_chars="n_chars").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Arrow files, read back: place, length and checksum of each document."""
    prepare(spark)
    manifest = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, manifest)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
    ("token files", tokens),
]

#: A trained model and hashed signatures are beyond SQL; tests/llm compares run() with a one-by-one version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage returns is written to the shared folder before the next one reads it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if place == len(STAGES) - 1:
            return made
        made.write.parquet(f"{folder}/{place}")
        docs = spark.read.parquet(f"{folder}/{place}")
    return docs
