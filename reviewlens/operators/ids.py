"""Dense sequential ids in arrival order without a single-task window.

``row_number()`` over a whole product would put a product holding a third of
the data into one task. Instead rows are grouped into fixed-width blocks of
the order key (at most ``2**block_bits`` rows each), the per-block counts are
prefix-summed (one small row per block), and each row's id is its block
offset plus its rank inside the block. Every shuffle is keyed by
(group, block), so no task sees more than one block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sequential_index(df: DataFrame, by: tuple[str, ...] = ("product",), order: str = "seq",
                     out: str = "idx", block_bits: int = 16) -> DataFrame:
    """0-based position of each row within ``by`` when sorted by ``order``."""
    blk = F.shiftright(F.col(order).cast("long"), block_bits)
    d = df.withColumn("__blk", blk)
    counts = d.groupBy(*by, "__blk").agg(F.count(F.lit(1)).alias("__n"))
    prefix = Window.partitionBy(*by).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(prefix), F.lit(0))).drop("__n")
    within = Window.partitionBy(*by, "__blk").orderBy(F.col(order).asc())
    return (d.join(offsets, [*by, "__blk"], "inner")
            .withColumn(out, F.col("__off") + F.row_number().over(within) - 1)
            .drop("__blk", "__off"))


def with_doc_ids(df: DataFrame, by: tuple[str, ...] = ("product",), order: str = "seq") -> DataFrame:
    """``doc_{i}`` ids, 0-based in arrival order per group."""
    return (sequential_index(df, by, order, "__i")
            .withColumn("doc_id", F.concat(F.lit("doc_"), F.col("__i").cast("string"))).drop("__i"))


def anonymise(df: DataFrame) -> DataFrame:
    """C4: drop the three identity columns."""
    return df.drop("review_id", "author", "timestamp")
