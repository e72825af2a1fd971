"""A training corpus in five stages: quality, near copies, decontamination, mixing, shards.

Each stage takes all that the one before kept, is written as Parquet and read
again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import decontam, jaccard, mixing, quality, sharding
from trackloom.llm.store import stored

SHARDS = 8
THRESHOLD = 0.3  # of the quality score

#: SQL has no trained classifier; the tests hold the other stages against brute-force versions.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that a classifier learned from ``labels`` scores below THRESHOLD."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # stored here, so that Python gets few whole texts at a time
    return stored(quality.good_documents(docs, model, THRESHOLD), "good-documents")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, similarity 0.8)."""
    return jaccard.drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that share ten words in a row, or a whole shorter item, with the benchmark."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, keep or leave out documents so that sources come to their target weights."""
    return mixing.mixed_documents(docs)


def jump_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each row a shard and a place in it; the documents' columns stay."""
    return sharding.with_shards(docs, SHARDS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("jump_sharding", jump_sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
