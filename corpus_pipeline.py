"""Corpus pipeline: language ID, near-dedup, decontamination, mixing and sharding, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import stored, table
from quillspark.llm.langid import drop_rejected
from quillspark.llm.mixing import poisson_mix, source_counts, tempered_weights
from quillspark.llm.sharding import shard
from quillspark.llm.simhash import keep_one_of_each
from quillspark.llm.winnow import drop_contaminated


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told; the dictionaries are learned from docs itself."""
    return drop_rejected(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id stays.

    Components are those of operator 2: fingerprints of 3-word shingles that link at 2 or fewer differing bits.
    """
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages to a twentieth of their words or more."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicates documents so that sources come near to the square roots of their sizes; rows may repeat."""
    counts = source_counts(docs)
    return poisson_mix(docs, tempered_weights(counts), counts=counts).select(docs.columns)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's place in one of 24 shards."""
    return shard(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", to_shards),
]

#: Compression and fingerprints of shingles have no SQL form; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written as Parquet and read by the next one."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
