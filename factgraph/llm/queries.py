"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factgraph.llm import avi, bpe, chat, class_ngram, packing, pii, pii_oracle, quality_classifier, quality_rules, simhash, substring_dedup, token_counts, vector_clusters, vector_codes
from factgraph.llm.common import table


def op1_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.crossed_pairs(table(spark, sf_dir, "conversations")))


def op2_avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.digests(table(spark, sf_dir, "documents"))


def op3_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.totals(table(spark, sf_dir, "documents"))


def op5_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op7_class_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_ngram.score(table(spark, sf_dir, "documents"))


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), pii.key_of(spark), found="n_found").select("doc_id", "text", "n_found")


def op9_attention_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op10_ngram_likelihood_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.score(docs, quality_rules.Ratio.fit(table(spark, sf_dir, "benchmark"), docs))


def op11_delta_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def op12_weighted_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_clusters.clusters(table(spark, sf_dir, "embeddings"))


def op13_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("kept_text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_preference_formatting, op2_avi_motion_jpeg, op3_cost_balanced_packing, op4_prefix_token_counts, op5_simhash_balls, op6_byte_bpe, op7_class_ngram, op8_feistel_pseudonyms, op9_attention_mil_quality, op10_ngram_likelihood_rules, op11_delta_lloyd_codes, op12_weighted_centroids, op13_count_min_substrings)}


def oracle_sql() -> dict[str, str]:
    return {"op1_preference_formatting": chat.ORACLE, "op8_feistel_pseudonyms": pii_oracle.sql(), "op11_delta_lloyd_codes": vector_codes.ORACLE, "op12_weighted_centroids": vector_clusters.ORACLE, "op13_count_min_substrings": substring_dedup.ORACLE}
