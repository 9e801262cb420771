"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the next stage's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statloom.llm import decontamination, neardup, packing, rules, substrings
from statloom.llm.inputs import table, written
from statloom.session import importable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go: too few words, too many repeated ones, or a vocabulary that doesn't fit. Null and empty texts are rejected."""
    return rules.filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays, that with the smallest doc_id; of equal rows one stays. Texts without words are linked with nothing."""
    return neardup.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a passage of 35 words that starts anywhere else go; every row stays, with an empty text if all its words went."""
    return substrings.without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go of whose words a twentieth or more lie in windows of benchmark items. Rows without words are clean."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 2048; a null or empty text has the closing id alone."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontaminate), ("packing", pack)]

#: Packing needs the ids of a public tokeniser, which SQL can't give.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    importable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
