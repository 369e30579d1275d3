"""Queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, bytecnn, chat, embeddings, exact, licenses, mixing, simhash, substrings
from .common import table


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(chat.with_extra(table(spark, sf_dir, "conversations")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytecnn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytecnn.language_ids(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.vector_links(table(spark, sf_dir, "embeddings"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs)


QUERIES = {f.__name__: f for f in (op1_suffix_array, op2_chat_format, op3_quality, op4_language, op5_simhash, op6_licenses, op7_exact_dedup, op8_embeddings, op9_bpe, op10_mix_sources)}
ORACLES = {
    "op1_suffix_array": substrings.SQL,
    "op2_chat_format": chat.SQL,
    "op6_licenses": licenses.SQL,
    "op7_exact_dedup": exact.SQL,
    "op8_embeddings": embeddings.SQL,
    "op10_mix_sources": mixing.SQL,
}
