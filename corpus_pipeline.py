"""Corpus pipeline: language filter, exact and near dedup, mixing, tokens.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kairos.llm import bpe, exactdedup, langid, mixing, simhash
from kairos.llm.common import stage
from kairos.session import ship_package
from kairos.sources import load


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text or no letter) go."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exactdedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the smallest doc_id stays."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digest of the decoded text."""
    return bpe.digests(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mixed), ("bpe", tokens)]

ORACLE_SQL = None  # a classifier and 64-bit shingle hashes: SQL can't express them


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; an empty table gives an empty result."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    docs = load(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
