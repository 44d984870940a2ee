"""Corpus pipeline: from raw documents to packed sequences in five stages, each written as Parquet and read by the next.

Language ID drops documents without a recognised language; near-duplicate detection leaves one document of each group;
decontamination drops documents that hold a passage of the benchmark; the secret scan masks every secret in the text;
best-fit packing lays the rest out in sequences. Each stage works on all rows that the one before kept, whole texts included.
Rows with null ids are in no group of near duplicates; all other decisions are of the text alone.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygraph.llm import decontaminate, language_id, near_dup, packing, secret_scan
from tallygraph.llm.shared import temporary_tables, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of a document's n-grams that its language must hold; running text has over 0.5, other matter near 0.
LEAST_SCORE = 0.2
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without(docs: DataFrame, rejected: DataFrame, *names: str) -> DataFrame:
    """The documents that are not among the rejected rows, told by the names and the digest of the text, so that another text of the same id stays."""
    gone = rejected.select(*[F.col(c).alias(f"_{c}") for c in names], F.col("text_sha256").alias("_text")).distinct()
    same = near_dup.text_digest(F.col("text")) == F.col("_text")
    for c in names:
        same &= F.col(c) == F.col(f"_{c}")
    return docs.select(*COLUMNS).join(gone, same, "left_anti")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the filters learnt from all labelled documents recognise; the verdict is of the text alone.

    Null and empty texts and those without a letter go; ids may be null or repeated, equal texts share their fate; of tied
    languages any keeps the document; extra columns are dropped; an empty table stays empty.
    """
    model = language_id.fit(docs, F.lit(True))
    judged = language_id.judged(docs.select(*COLUMNS), model)
    return judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group (similarity 0.8 of five-word shingles): that with the least doc_id.

    Null and empty texts and null ids are in no group and stay; so do repeated rows of the least id, which is kept as a
    whole; of one id with different texts only those in the group of a smaller id go; extra columns are dropped; an empty
    table stays empty.
    """
    return without(docs, near_dup.near_duplicates(docs).filter("NOT kept"), "doc_id")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage within the edit distance of a benchmark item.

    The text alone decides, so equal texts share their fate whatever their ids, null ones included, and other texts of an
    id stay; null and empty texts hold no passage and stay; extra columns are dropped; an empty table of documents stays
    empty, an empty benchmark drops nothing.
    """
    texts = docs.select(near_dup.text_digest(F.col("text")), "text")
    leaks = decontaminate.contaminated(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="text_sha256")
    return without(docs, leaks.withColumnRenamed("doc_id", "text_sha256"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret of the scan's findings replaced by asterisks of its length.

    Blobs and rule versions that the ledger holds (secret_scan.ledger_path) are not scanned again. Null texts stay null and
    empty ones empty; copies are masked alike whatever their ids; overlapping spans are masked once; extra columns are
    dropped; an empty table stays empty.
    """
    found = secret_scan.findings(secret_scan.scan_into(docs, secret_scan.ledger_path(spark)))
    return secret_scan.masked(docs.select(*COLUMNS), found).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for every piece of every document.

    Null and empty texts are one closing token, very long ones are cut at the capacity; null, repeated and tied rows are
    packed one by one; extra columns are not looked at; an empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", languages),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_free),
    ("secret_scan", secrets_masked),
    ("packing", sequences),
]
#: Sketches, embeddings and tokenizers are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with temporary_tables(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", lasting=True)
    return docs
