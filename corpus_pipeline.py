"""The corpus pipeline: classify, deduplicate, mask secrets, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one gets it written and read again.

In every stage null and empty texts are documents like others until mixing, which takes no words of them; very long texts go
through whole; null ids are kept, and a null id is the last that a group of near duplicates keeps; rows that repeat in all
columns are one document for the near-duplicate stage and are otherwise treated alike; ties go by a hash of the row, so
reruns agree; extra columns of any name come through to mixing; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyfield.llm import mixing, packing, quality, secrets, simhash
from tallyfield.llm.common import forget, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least id."""
    return simhash.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, none of which crosses documents."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scan", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: Classifier, fingerprints and tokenizers have no SQL; tests hold run() against plain Python, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
            if before is not None:
                forget(before)
            before = docs
    return docs
