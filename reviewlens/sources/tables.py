"""Readers for the parquet tables the jobs run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; column pruning and filter pushdown are left to Catalyst."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the tables as temp views for SQL use."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Spread a scan over the cluster's cores when it has fewer splits than cores.

    Text tables can be few row groups but heavy per row (regexes, trigram
    explosion); a scan with fewer input splits than cores would run that work
    on a handful of tasks. Large inputs already have enough splits and are
    returned unchanged (no shuffle added).
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # no SparkContext (e.g. Spark Connect): leave the scan as it is
        return df
    if splits < cores:
        return df.repartition(cores * factor)
    return df


def read_text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, name))
