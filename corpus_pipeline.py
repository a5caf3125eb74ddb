"""A corpus pipeline of five stages; each works on all that the one before kept.

Language identification rejects documents in no known language, near-duplicate groups keep one document, documents with benchmark
passages go, personal data is masked, and what is left is packed into sequences. Every stage keeps a table of the columns of
documents (the last returns pieces); null and empty texts, nulls in any column and repeated rows go through as each operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import decontaminate, langid, near_dup, packing, pii
from codelode.llm._common import small_batches, table, written


#: Of shingle sets from which documents are near duplicates; op6 alone has a contract of 0.85.
SIMILARITY = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from those that are labelled; lang is filled in where it is null.

    What has no text or no letter has no language and goes.
    """
    small_batches(spark)
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = langid.train(learn.where(langid.remainder() != 2))
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    known = langid.identify(rows, counts, keep=["row"]).where(F.col("lang_pred") != langid.UND)
    return known.select(*[F.coalesce(F.col("row.lang"), F.col("lang_pred")).alias("lang") if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of SIMILARITY or more."""
    return near_dup.keep_one(docs, similarity=SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage was found."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked by its kind, and n_chars of what is left."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packed)]
#: SQL expresses neither the language model nor the tokenizer; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
