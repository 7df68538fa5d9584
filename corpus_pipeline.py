"""Cleaning and packing of a corpus in five stages, each by one operator of ``factgraph.llm``.

A stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of
``documents``.  ``run`` applies them in order, with each stage's result written to the shared checkpoint folder before
the next one reads it, so a lost executor costs no more than its part of a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm import packing, pii, quality_classifier, quality_rules, simhash_similarity
from factgraph.llm.common import cut_lineage, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones among ``docs``."""
    return quality_classifier.keep(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio against this stage's own input."""
    return quality_rules.keep(docs, quality_rules.Ratio.fit(table(spark, sf_dir, "benchmark"), docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similarity 0.8 of 5-word shingles the one of the smallest id.

    SimHash balls over blocks of a wide fingerprint find the candidates; links are verified on the whole sets.
    """
    return simhash_similarity.deduplicate(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated personal numbers, dates and addresses replaced in the texts; ``n_chars`` follows the new text."""
    out = pii.pseudonymise(docs, pii.key_of(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_quality_rules),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", pseudonymise),
    ("packing", pack),
]

#: The stages learn models and hash n-grams, which SQL can't express; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
