"""A document pipeline: quality rules, line dedup, near duplicates, mixing, BPE.

Each stage takes the documents that the one before it kept, applies its operator to all of
them, and returns the documents table again; the last one returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabletidy.llm.bpe import bpe
from tabletidy.llm.common import staged
from tabletidy.llm.jaccard_join import keep_one
from tabletidy.llm.line_dedup import drop_lines
from tabletidy.llm.mixing import mix_sources
from tabletidy.llm.quality_rules import keep_good
from tabletidy.llm.queries import token_digests, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far out of their language and source go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more in five documents or more stay in the last of them only."""
    return drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by a Jaccard similarity of 0.8 the first stays."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; sources below the largest repeat, at most twice."""
    return mix_sources(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row the number of tokens and the hashes of its ids and of the decoded text."""
    return token_digests(bpe(docs, vocabulary()))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("mixing", mixing),
    ("bpe", encoding),
]

#: Robust estimates, components and BPE merges have no SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
