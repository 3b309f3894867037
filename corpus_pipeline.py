"""The corpus pipeline: language, quality, near duplicates, repeated sentences, packed windows.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept.  All but the last return the columns of
documents; the last returns one row for each packed piece.  Null texts and texts without letters leave in the first
stage, so later ones meet text; an empty table passes through every stage as an empty table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import bottomk, langmix, packing, quality, spans
from sievework.llm.common import crc_mod, fresh, materialise

#: A document whose first language holds less of it than this is rejected.
MIN_LANGUAGE_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null or without letters, and those where no language has a clear share."""
    model = langmix.learn(docs.filter(crc_mod(F.col("doc_id"), 3) != 1))
    return langmix.clear_only(docs, model, MIN_LANGUAGE_SHARE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the rules fail; failing lines leave the others."""
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id; rows of null id are in no group and stay."""
    its_key = fresh(docs, "key")
    kept = bottomk.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias(its_key))
    # the ids are hashed, so texts are shuffled once but never sorted
    named = docs.join(kept.distinct().hint("shuffle_hash"), docs["doc_id"] == F.col(its_key), "left_semi")
    return named.unionByName(docs.filter("doc_id is null"))


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of repeated spans leave all documents but the first; a document left without text goes."""
    lost = fresh(docs, "n_removed")
    return spans.strip_repeats(docs, removed=lost).filter(F.length(F.trim("text")) > 0).drop(lost)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of the documents that are left."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("span_dedup", span_dedup),
    ("packing", packing_stage),
]

#: Language mixtures and union-sketch groups have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
