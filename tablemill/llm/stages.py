"""Pipeline stages: each takes (spark, docs, sf_dir) and keeps the columns of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablemill.functions.numbers import quoted
from tablemill.llm import contamination, packing, paragraphs, quality_model, similar
from tablemill.sources.tables import read_table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their labels, does not reject."""
    model = quality_model.train(docs, read_table(spark, sf_dir, "labels"))
    kept = quality_model.score(docs, model).where("predicted = 1")
    return kept.select(*[quoted(c) for c in docs.columns])


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return similar.one_per_class(docs)


def unrepeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds."""
    return paragraphs.remove_repeated(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a notable share of benchmark text."""
    return contamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences, with their token ids."""
    return packing.pack_documents(docs, with_ids=True, keep_encoder=False)
