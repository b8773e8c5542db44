"""From raw documents to token ids: five stages, each written as Parquet before the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm.bpe import VOCABULARY, encode_documents
from tablewright.llm.langid import keep_identified
from tablewright.llm.minhash import keep_one_of_each
from tablewright.llm.mixing import mix_documents
from tablewright.llm.queries import tokenizer_path
from tablewright.llm.substring_dedup import dedup_substrings
from tablewright.runtime import new_folder, owned_tables


# Rows of a batch between Spark and its Python workers. Texts are long and are passed on
# whole, and the workers of several stages live in one executor.
BATCH_ROWS = 2_000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without a letter."""
    _small_batches(spark)
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    _small_batches(spark)
    return keep_one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that also stand earlier go; so do documents of which nothing is left."""
    _small_batches(spark)
    cut_down = dedup_substrings(docs).where("n_words = 0 or n_removed < n_words")
    return cut_down.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn, some of them twice, until every source meets its target."""
    _small_batches(spark)
    return mix_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the decoded text."""
    _small_batches(spark)
    return encode_documents(docs, tokenizer_path(VOCABULARY), with_ids=True)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("bpe", bpe)]
# A trained network decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; what a stage wrote on the way is deleted after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        with owned_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
