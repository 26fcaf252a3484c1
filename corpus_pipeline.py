"""Corpus pipeline: documents without toxic, low-quality and near-duplicate ones, mixed to weights and packed.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages before the last
return the columns of documents; the mix repeats a row for each copy that it takes, so packing sees a repeated
document once for each copy. Null and empty texts fall to the quality rules; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verisift.llm import jaccard, mixing, packing, quality, toxicity
from verisift.llm.common import drop_staged, staged, table

#: Toxicity is a trained model and near-duplicate groups are a closure: tested against brute force instead.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic),
    ("quality_rules", rules),
    ("ngram_jaccard", near_copies),
    ("source_mix", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_staged(docs)  # what the stage before has written; the given table stays
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
