"""Registered queries of the corpus operators, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablemill.llm import contamination, conversations, fingerprints, licences, oracles, packing, paragraphs, quality_model, quality_rules, sharding, similar, spelling, token_counts, wavelet
from tablemill.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_uniform_shards")
def op1_uniform_shards(spark, folder):
    return sharding.shard_documents(read_table(spark, folder, "documents"))


@query("op3_quality_rules", oracles.quality_rules_sql())
def op3_quality_rules(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs).drop("text")


@query("op4_decontamination", oracles.contamination_sql())
def op4_decontamination(spark, folder):
    found = contamination.contamination(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return found.drop("print", "spans")


@query("op7_quality_classifier")
def op7_quality_classifier(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    model = quality_model.train(docs, read_table(spark, folder, "labels"))
    held_out = quality_model.crc_remainder(F.col("doc_id")) == 2
    return quality_model.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op9_jaccard_join")
def op9_jaccard_join(spark, folder):
    found = similar.similar_documents(read_table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_copies")


@query("op5_token_counts")
def op5_token_counts(spark, folder):
    counts = token_counts.count_tokens(read_table(spark, folder, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT)


@query("op6_packing")
def op6_packing(spark, folder):
    return packing.pack_documents(read_table(spark, folder, "documents"))


@query("op8_wavelet_shards")
def op8_wavelet_shards(spark, folder):
    return wavelet.encode_documents(read_table(spark, folder, "documents"))


@query("op2_paragraph_dedup")
def op2_paragraph_dedup(spark, folder):
    return paragraphs.repeated_pairs(read_table(spark, folder, "documents"))


@query("op10_licence_scan", oracles.licences_sql())
def op10_licence_scan(spark, folder):
    return licences.scan(licences.document_paths(read_table(spark, folder, "documents"))).drop("text")


@query("op11_document_fingerprints")
def op11_document_fingerprints(spark, folder):
    return fingerprints.fingerprint_edits(read_table(spark, folder, "documents"))


@query("op13_spelling_variants")
def op13_spelling_variants(spark, folder):
    return spelling.spelling_variants(read_table(spark, folder, "documents"))


@query("op12_conversation_repair")
def op12_conversation_repair(spark, folder):
    return conversations.repair_conversations(read_table(spark, folder, "conversations"))
