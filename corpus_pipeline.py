"""A training-data pipeline over ``documents``; every stage is one operator of postwatch.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from postwatch.llm import byte_bpe, curriculum, jaccard, line_quality, substrings
from postwatch.llm.common import documents, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, lines that are frequent in their host are cut."""
    return line_quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, the one of the smallest doc_id."""
    return jaccard.keep_one(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that occur elsewhere go; documents with nothing left go."""
    return substrings.deduplicate(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, in training order."""
    return curriculum.training_stream(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them, row by row."""
    return byte_bpe.round_trip(
        docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_spans),
    ("mixing sources", mixing),
    ("byte-level BPE", encoding),
]

#: Byte-level BPE and component search are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage_of in STAGES:
        docs = stage(stage_of(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
