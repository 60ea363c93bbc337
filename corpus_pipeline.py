"""A pipeline from raw documents to token ids, in five stages.

Each stage is written as Parquet in the shared folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barrspark.llm import block_naming, byte_bpe, langid_bayes, simhash_ball, temperature_mix
from barrspark.llm.common import materialize
from barrspark.llm.queries import bpe_vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not identified: no letter, or a posterior under one half."""
    return langid_bayes.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest stays, then the smallest id."""
    return block_naming.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal fingerprints, the smallest id stays."""
    return simhash_ball.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, out of as many tokens as there are."""
    return temperature_mix.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's tokens, with the digests of ids and decoded bytes."""
    ranks, pattern = bpe_vocabulary()
    return byte_bpe.encode_and_check(docs, ranks, pattern, keep_ids=True, apart=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("temperature_mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: SQL cannot express the classifier, the fingerprints or the merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
