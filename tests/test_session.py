"""Session settings: what a task reads after a shuffle is bounded."""

from pyspark.sql import functions as F


def test_large_shuffles_are_read_in_small_parts(spark):
    """Rows of some 70 MB once packed are not merged into parts of 64 MB."""
    first = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    spark.conf.set(first, "false")
    try:
        rows = spark.range(1_000_000, numPartitions=4).select("id", F.concat(F.sha2(F.col("id").cast("string"), 256), F.md5(F.hex("id"))).alias("t"))
        assert rows.repartition("id").rdd.getNumPartitions() >= 4
    finally:
        spark.conf.unset(first)
