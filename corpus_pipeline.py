"""Corpus pipeline: toxic documents go, near-duplicates and benchmark leaks go, secrets are masked, tokens come out.

Each stage takes all rows its predecessor kept. Null and empty texts pass the filters (as one
document of the component of empty texts) and end without pieces; rows that repeat a document are
near-duplicates of it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from veracol.llm import decontamination, jaccard_dedup, piece_codec, secret_scan, toxicity
from veracol.llm.shared import cut, table


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels that are not held out."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return jaccard_dedup.drop_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to their kinds; the number of characters follows the text."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, the ids' number and checksum, and whether they decode to the text."""
    return piece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), docs.columns)


STAGES = [("toxic_documents", toxic_documents), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("secrets", secrets), ("tokens", tokens)]

# A trained model, fingerprints and piece ids have no SQL form; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each over the written rows of the one before."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
