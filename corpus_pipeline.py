"""A corpus pipeline over ``documents``: each stage applies one text operator to what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.llm import bpe, bytecnn, exact, mixing, simhash


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality network, learned from the labels of these documents, predicts to be of quality 0."""
    return bytecnn.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    return exact.drop_exact_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash group."""
    return simhash.drop_near_copies(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put all documents in the order of the mixing schedule."""
    return mixing.mixed(docs)


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return bpe.token_digests(docs)


STAGES = [
    ("quality classifier", good_text),
    ("exact dedup", no_exact_copies),
    ("simhash near-dedup", no_near_copies),
    ("source mixing", mixed_sources),
    ("bpe coding", token_digests),
]
#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
