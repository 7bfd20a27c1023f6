"""A corpus pipeline of five operators; each stage gets the documents that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framegrid.llm import classifier, minhash, mixing, packing, pii
from framegrid.llm.common import made, release, scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the highest grade, by a model fitted on the rated ones among ``docs``.

    Null and blank texts go; repeated rows stay or go together; with no ratings nothing is kept.
    """
    return classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingle sets of similarity 0.8 or more: the smallest id, with all its rows.

    Null texts and null ids have no group and stay.
    """
    return minhash.drop_near_duplicates(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and identifiers found from contexts are replaced by their kinds; no row goes, a null text stays null."""
    return pii.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for; a null source is one of its own, null ids draw alike."""
    return mixing.mix_sources(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset; a null text gives the end id alone, an empty table nothing."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", minhash_near_dedup),
    ("pii", pii_redaction),
    ("mixing sources", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: The classifier, the tokenizer and the packing are not SQL; a test holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's rows are written and read again, its scratch tables go then.

    Columns beyond those of documents are carried along by all stages but the last.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path, before = scratch(spark, name.replace(" ", "-")), made()
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, before)
        docs = spark.read.parquet(path)
    return docs
