"""The corpus pipeline: stages over the documents table, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablemill.llm import stages
from tablemill.session import materialised
from tablemill.sources.tables import read_table

STAGES = [
    ("quality_classifier", stages.good_documents),
    ("ngram_jaccard_join", stages.different_documents),
    ("substring_dedup", stages.unrepeated_passages),
    ("benchmark_decontamination", stages.uncontaminated),
    ("packing", stages.packed),
]
#: The classifier is trained and the packer uses a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; the rows of the last one."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return docs
