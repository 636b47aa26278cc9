"""The corpus pipeline: quality rules, toxicity, SimHash near-dedup, substring dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Classifiers are fitted on sf_dir's labels with the
texts that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm import line_crf, ordinal, packing, similar, substring
from ledgerlake.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are mostly boilerplate go."""
    return line_crf.filtered(docs, line_crf.trained(docs, table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely toxic than not go."""
    return ordinal.filtered(docs, ordinal.trained(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; linked are texts of a similarity of 0.8 or more in five-word shingles."""
    return similar.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows go; every document stays, with the words it has left."""
    return substring.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces, placed in sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", pack),
]

#: The stages' models and tokenizer are beyond SQL: tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
