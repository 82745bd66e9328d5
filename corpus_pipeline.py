"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

Every stage takes the columns of documents, and whatever others there are, and returns them (the last one with its own
besides, whose names get underscores where they are taken). Null and empty texts pass all stages but the mix, which takes
them at their source's rate; null doc_ids are told apart by nothing but their rows, null sources are one source. Rows that are
equal stay or go together. Empty tables give empty ones, without labels no document is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillstone.llm import line_dedup, minmax_dedup, mixing, toxicity, unigram
from rillstone.llm.common import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that score one half or more. Null and empty texts score the bias, which is
    less as long as fewer than half of the labels are toxic."""
    return toxicity.toxicity_filter(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which nothing with a letter or digit is left. Null and empty texts have no lines
    and stay."""
    return line_dedup.drop_repeated_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id. Texts without words and rows without
    a doc_id stay."""
    return minmax_dedup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it. Where a source has no words its rows are not taken."""
    return mixing.mix_sources(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids; null and empty texts have none."""
    return unigram.encode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("minmax_dedup", near_dedup_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Hashing, learning and segmentation are beyond SQL; a test holds the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
