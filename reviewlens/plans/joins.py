"""Join strategies for a big side against a data-derived small side.

``lookup_join`` broadcasts the small side only after counting it against a
row budget (the small side is persisted first, so the count and the join read
it once). Above the budget it falls back to a salted shuffle join: the big
side gets a salt from a hash of its own columns and the small side is
replicated once per salt, so a key holding a third of the big side is spread
over ``salt_buckets`` tasks instead of one.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                row_bytes=256, max_bytes: int = DEFAULT_BROADCAST_BYTES,
                salt_buckets: int = 32, salt_cols: list[str] | None = None) -> DataFrame:
    """Join ``big`` to ``small`` on ``on`` (``how`` in inner / left / left_semi / left_anti).

    ``row_bytes`` is a per-row size estimate: an int, or a Column expression
    (e.g. from an array length) summed over the small side in the same pass
    that materialises it.
    """
    small = small.persist(StorageLevel.MEMORY_AND_DISK)
    est = row_bytes if not isinstance(row_bytes, int) else F.lit(row_bytes)
    total = small.agg(F.coalesce(F.sum(est.cast("long")), F.lit(0))).first()[0]
    if total <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, how, salt_buckets, salt_cols)


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                salt_buckets: int = 32, salt_cols: list[str] | None = None) -> DataFrame:
    """Shuffle join with the hot keys of ``big`` spread over ``salt_buckets`` salts."""
    cols = salt_cols or [c for c in big.columns if c not in on]
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(salt_buckets)) if cols else F.lit(0)
    b = big.withColumn("__salt", salt)
    s = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    return b.join(s, [*on, "__salt"], how).drop("__salt")
