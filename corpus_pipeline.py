"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reviewlens.llm import bpe, decontaminate, quality, secret_scan, simhash_dedup
from reviewlens.llm.common import table, written

#: Rows of an Arrow batch while the stages run. Rows hold whole texts, and batches wait on both sides of a Python worker.
ARROW_ROWS = 1_000


def small_batches(stage):
    """``stage`` with batches of ``ARROW_ROWS`` rows at most in its session."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
            spark.conf.set(name, str(ARROW_ROWS))
        return stage(spark, docs, sf_dir)

    return run


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the labels of ``docs`` train the model."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 3-word shingles, 2 bits."""
    return simhash_dedup.keep_one(docs, width=3, radius=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secret_scan.redact(docs, secret_scan.train(secret_scan.labelled_findings(docs), docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests that prove the round trip."""
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
                      keep_ids=True)


STAGES = [
    ("quality", small_batches(quality_stage)),
    ("near_duplicates", small_batches(near_duplicate_stage)),
    ("decontamination", small_batches(decontamination_stage)),
    ("secrets", small_batches(secret_stage)),
    ("encoding", small_batches(encoding_stage)),
]

# Learned models, alignments and byte-pair merges are not for SQL; tests/llm compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
