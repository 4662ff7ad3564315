"""Corpus preparation: stages that each take documents and, but for the last, return the columns of documents.

Null ids, languages, sources and texts are values like others; a null or empty text is rejected by the first stage.
Repeated rows are judged one by one until the second stage, which keeps one of them. Ties go to the smaller id, very
long texts pass through whole, an empty table stays empty through all stages, and columns that documents doesn't have
by contract are dropped by the first one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctide.llm import bpe, kneser_ney, mixing, near_dup, pii
from doctide.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _row_key(text: Column) -> list[Column]:
    """Id, language and text of a row as columns that are never null, for joins and groups."""
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("k_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("k_lang"), text.alias("k_text")]


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, *_row_key(F.xxhash64(F.col("text").cast("string"))))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the character model doesn't reject, by id, language and text: of a repeated id each text has its own verdict."""
    told = kneser_ney.classify(docs, table(spark, sf_dir, "labels")).filter("kept").select(*_row_key(F.col("text_hash"))).distinct()
    return _with_key(docs).join(told, ["k_id", "k_lang", "k_text"], "left_semi").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, a null id being the largest.

    Rows equal in id and text are one document, of which one row stays; so are wordless ones, which are linked with nothing.
    """
    first = near_dup.link(docs).filter("first").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("k_id"), F.col("text_hash").alias("k_text")).distinct()
    return _with_key(docs).join(first, ["k_id", "k_text"], "left_semi").dropDuplicates(["k_id", "k_text"]).select(*COLUMNS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    clean = pii.scan(docs, ("doc_id", "lang", "source", "n_chars"), redacted=True)
    return clean.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.coalesce(F.length("redacted").cast("long"), "n_chars").alias("n_chars"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one taken twice makes two rows. A document is told by id and text, rows of null ids too."""
    keyed = docs.select(*COLUMNS, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(F.col("text").cast("string")).cast("string")).alias("key"))
    sized = keyed.select(F.col("key").alias("doc_id"), "source", mixing.word_count(F.col("text")).alias("size"))
    weights = mixing.ranked_weights(docs.select("source").distinct(), (5.0, 2.0, 1.0))
    taken = mixing.mix(sized, weights, share=1.5).filter("repeats > 0").groupBy(F.col("doc_id").alias("key")).agg(F.max("repeats").alias("repeats"))
    again = F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias("time")
    return keyed.join(taken, "key").select(*COLUMNS, again).drop("time")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, a row for each document taken."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("near dedup", near_dedup),
    ("pii", private_data),
    ("mixing", mixing_sources),
    ("bpe", encoding),
]

#: SQL can't express the language model, the obfuscated personal data or the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
