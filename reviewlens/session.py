"""Spark session helpers.

The library never creates a cluster-wide setting it does not own, and no
scratch folder.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes, splits
# skewed shuffle partitions and coalesces small ones, up to a size whose rows
# a task can explode, sort and count in a few hundred MB; UTC keeps timestamps
# comparable with the SQL oracle.
_SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(16 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_session(master: str | None = None, app_name: str = "reviewlens",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Create or reuse a session with the library's settings applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", os.environ.get("REVIEWLENS_DRIVER_MEM", "16g"))
    for k, v in _SQL_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session."""
    for k, v in _SQL_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # a setting the deployment has locked stays as it is
            pass
    return spark
