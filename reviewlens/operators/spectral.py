"""Reduction to few dimensions that follows a neighbour graph.

Block power iteration on the normalised graph: every step averages a node's
coordinates with its neighbours', then makes the coordinates orthogonal again.
A step is one join and one aggregation that combines before it moves; the
orthogonalisation needs a Gram matrix of a few numbers only. The start is
fixed (sign projections of the vectors), so the result is too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.operators.vectors import sign_projection
from reviewlens.sources.shared import checkpointed

START_MASKS = (11, 21, 38, 13, 50, 25, 44, 7, 56, 35)  # any distinct masks do; their projections are orthogonal


def symmetric(graph: DataFrame) -> DataFrame:
    """(node, other, w): every link of ``graph`` both ways, weighted by the inverse root of both degrees."""
    both = graph.select("node", "other").union(graph.select(F.col("other").alias("node"), F.col("node").alias("other")))
    links = both.filter("node <> other").distinct()
    degree = links.groupBy("node").agg(F.count("*").alias("n"))
    return (links.join(degree, "node").join(degree.select(F.col("node").alias("other"), F.col("n").alias("m")), "other")
            .select("node", "other", (1.0 / F.sqrt(F.col("n").cast("double") * F.col("m"))).alias("w"),
                    F.col("n").alias("degree")))


def _combined(columns: list[Column], weights: np.ndarray) -> Column:
    total = F.lit(0.0)
    for c, w in zip(columns, weights.tolist()):
        total = total + c * F.lit(w)
    return total


def _orthogonal(x: DataFrame, k: int) -> DataFrame:
    """Coordinates ``x0``.. made orthonormal and free of the trivial direction ``base`` (the root of the degree)."""
    columns = [F.col("base"), *[F.col(f"x{i}") for i in range(k)]]
    sums = x.agg(*[F.sum(columns[i] * columns[j]).alias(f"g{i}_{j}") for i in range(k + 1) for j in range(i + 1)]).first()
    if sums["g0_0"] is None:
        return x
    gram = np.array([[float(sums[f"g{max(i, j)}_{min(i, j)}"]) for j in range(k + 1)] for i in range(k + 1)])
    basis = np.zeros((k, k + 1))  # row i: the new coordinate i in terms of base, x0, ..
    known = [np.eye(k + 1)[0] / np.sqrt(gram[0, 0])]
    for i in range(k):
        row = np.eye(k + 1)[i + 1]
        for _ in range(2):  # once more against rounding
            for other in known:
                row = row - (row @ gram @ other) * other
        length = row @ gram @ row
        basis[i] = row / np.sqrt(length) if length > 1e-12 * gram[i + 1, i + 1] else 0.0  # a coordinate that the others span
        known.append(basis[i])
    return x.select("id", "base", *[_combined(columns, basis[i]).alias(f"x{i}") for i in range(k)])


def spectral_reduce(nodes: DataFrame, graph: DataFrame, dims: int, k: int = 5, steps: int = 10,
                    out: str = "reduced") -> DataFrame:
    """(id, ``out``) with ``k`` coordinates for each row of ``nodes`` (id, vec) that ``graph`` (node, other) links.

    Coordinates are rounded to nine digits. Nodes without a link have no row.
    Each step ends in a reliable checkpoint.
    """
    if not 1 <= k <= len(START_MASKS):
        raise ValueError(f"k must be 1 to {len(START_MASKS)}")
    links = checkpointed(symmetric(graph))
    base = links.groupBy(F.col("node").alias("id")).agg(F.sqrt(F.first("degree").cast("double")).alias("base"))
    start = nodes.select("id", *[F.get(sign_projection(F.col("vec"), dims, START_MASKS[:k]), F.lit(i)).alias(f"x{i}")
                                 for i in range(k)])
    names = [f"x{i}" for i in range(k)]
    x = checkpointed(base.join(start, "id").select("id", "base", *names))
    for _ in range(steps):
        given = x.select(F.col("id").alias("other"), *names)
        around = links.join(given, "other").groupBy(F.col("node").alias("id")).agg(
            *[F.sum(F.col("w") * F.col(n)).alias(f"s{n}") for n in names])
        moved = checkpointed(x.join(around, "id").select("id", "base", *[((F.col(n) + F.col(f"s{n}")) / 2).alias(n) for n in names]))
        x = _orthogonal(moved, k)
    return x.select("id", F.array(*[F.round(F.col(n) / F.col("base"), 9) for n in names]).alias(out))
