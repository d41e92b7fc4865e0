"""A corpus from raw documents to tokens: quality, near-duplicates, secrets, mixture, BPE.

Every stage works on all that the one before kept; its output is written as Parquet and read again. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nichegraph.llm import bpe_trie, mixing, near_dedup, quality_rules, secret_scan, shared

#: Characters of words that a worker of the last stage keeps, and of text that it encodes at once: fewer than bpe_trie's, as
#: the workers live on beside the other stages of a session.
KEPT_CHARS, CHARS = 10_000_000, 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on labels, rejects go."""
    return quality_rules.kept(docs, shared.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id: fingerprints two bits apart, or 0.8 of the runs of five words in common."""
    return near_dedup.deduplicated(docs, similarity=near_dedup.SIMILARITY)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; no document goes."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources and languages approach their tempered shares of tokens."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as BPE tokens: their number, and digests of the ids and of the decoded text."""
    return bpe_trie.digests(docs, kept_chars=KEPT_CHARS, chars=CHARS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("tokens", tokens)]

#: No SQL: the stages hash with XXH64, fit a model and tokenize.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir))
    return docs
