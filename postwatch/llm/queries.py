"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe, class_lm, cover_search, curriculum, jaccard, lang_ecoc, line_quality, negatives,
    polytope, substrings, token_store, warc, whitening,
)
from .common import documents


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_locate(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op2_lang_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_ecoc.predict(documents(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN)


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.in_training_order(curriculum.mix(documents(spark, sf_dir))).select(
        "doc_id", "size", "source_size", "target", "taken")


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "removed_words")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir)).select(
        "doc_id", "n_shingles", "component_id", "n_links")


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_assemble(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_search.top_k(embeddings(spark, sf_dir), every=50, k=5)


def op11_jacobi_davidson_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir), components=4).withColumn(
        "deviation", F.expr("try_cast(deviation AS long)"))


def op12_polytope_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polytope.near_duplicates(embeddings(spark, sf_dir), threshold=0.98)


def op13_four_russians_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = embeddings(spark, sf_dir).withColumn("label", F.expr(
        "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return negatives.mine(relabelled, every=50, positives=5, negatives=3, low=50, high=95)


QUERIES = {f.__name__: f for f in (
    op1_token_orc, op2_lang_ecoc, op3_byte_bpe, op4_curriculum_mix, op5_line_quality,
    op6_jaccard_join, op7_class_lm, op8_substring_dedup, op9_warc_transactions, op10_cover_tree_top_k,
    op11_jacobi_davidson_whitening, op12_polytope_near_duplicates, op13_four_russians_negatives)}

ORACLES = {
    "op4_curriculum_mix": curriculum.ORACLE_SQL,
    "op5_line_quality": line_quality.ORACLE_SQL,
    "op8_substring_dedup": substrings.ORACLE_SQL,
    "op9_warc_transactions": warc.ORACLE_SQL,
    "op10_cover_tree_top_k": cover_search.ORACLE_SQL,
    "op12_polytope_near_duplicates": polytope.ORACLE_SQL,
    "op13_four_russians_negatives": negatives.ORACLE_SQL,
}
