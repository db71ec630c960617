"""Cluster statistics, centroids, representatives and ranking
(D1, D6, B10, E1-E4, G4, F2, F3, G5).

A cluster is keyed by (group..., cluster_id); the group is normally the
product, so many products are clustered in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.fixed_values import NOISE_LABEL, REPRESENTATIVES_PER_CLUSTER, TOP_CLUSTERS
from reviewlens.plans.joins import lookup_join


def attach_vectors(reviews: DataFrame, vectors: DataFrame, review_key: str = "seq",
                   vector_key: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", noise_labels: tuple[int, ...] = ()) -> DataFrame:
    """Review <-> label <-> vector by key (the positional zip as an equi join).

    Labels listed in ``noise_labels`` become the noise label -1.
    """
    lab = F.col(label_col)
    if noise_labels:
        lab = F.when(lab.isin(*noise_labels), F.lit(NOISE_LABEL)).otherwise(lab)
    v = vectors.select(F.col(vector_key).alias(review_key), F.col(vector_col).alias("embedding"),
                       lab.cast("int").alias("cluster_id"))
    return reviews.join(v, review_key, "inner")


def drop_noise(members: DataFrame) -> DataFrame:
    """B10."""
    return members.filter(F.col("cluster_id") != NOISE_LABEL)


def cluster_stats(members: DataFrame, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """E1 + E2: size, rating sum and mean rating (2 dp half-even) per cluster."""
    return (drop_noise(members).groupBy(*by, "cluster_id")
            .agg(F.count(F.lit(1)).alias("size"),
                 F.sum("rating").cast("long").alias("rating_sum"),
                 F.bround(F.avg("rating"), 2).alias("avg_rating")))


def global_mean(reviews: DataFrame, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """Unrounded mean rating over all clustered reviews (noise included)."""
    return reviews.groupBy(*by).agg(F.avg("rating").alias("global_mean"))


def centroid_cells(members: DataFrame, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """E3 (long form): element-wise mean of the original vectors, one row per dimension.

    The explode and the partial average run in the same map stage, so only
    (cluster, dimension) partial sums cross the shuffle.
    """
    return (drop_noise(members)
            .select(*by, "cluster_id", F.posexplode("embedding").alias("dim", "v"))
            .groupBy(*by, "cluster_id", "dim").agg(F.avg(F.col("v").cast("double")).alias("value")))


def centroids(members: DataFrame, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """Centroid as ``array<double>`` ordered by dimension."""
    cells = centroid_cells(members, by)
    return (cells.groupBy(*by, "cluster_id")
            .agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("__c"))
            .select(*by, "cluster_id", F.transform("__c", lambda x: x["value"]).alias("centroid")))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance of two equal-length numeric arrays."""
    sq = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def member_distances(members: DataFrame, cents: DataFrame, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """Distance of every member to its cluster centroid.

    The centroid table has one row per cluster; it is broadcast when its
    counted size fits, otherwise joined with salting so a hot cluster is
    spread over many tasks.
    """
    row_bytes = F.size("centroid") * 8 + 64
    j = lookup_join(drop_noise(members), cents, [*by, "cluster_id"], "inner",
                    row_bytes=row_bytes, salt_cols=["seq"])
    return j.withColumn("dist", euclidean(F.col("embedding"), F.col("centroid"))).drop("centroid")


def representatives(dists: DataFrame, k: int = REPRESENTATIVES_PER_CLUSTER,
                    by: tuple[str, ...] = ("product",)) -> DataFrame:
    """the ``k`` members nearest the centroid (ties by arrival order).

    ``row_number() <= k`` gets a partial WindowGroupLimit before the shuffle.
    """
    w = Window.partitionBy(*by, "cluster_id").orderBy(F.col("dist").asc(), F.col("seq").asc())
    return dists.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rank_clusters(stats: DataFrame, means: DataFrame, top_n: int = TOP_CLUSTERS,
                  by: tuple[str, ...] = ("product",)) -> DataFrame:
    """F3 + D6: size desc, then (rounded mean - global mean) asc, then id; first ``top_n``."""
    s = stats.join(means, list(by), "inner").withColumn(
        "rating_delta", F.col("avg_rating") - F.col("global_mean"))
    w = Window.partitionBy(*by).orderBy(F.col("size").desc(), F.col("rating_delta").asc(),
                                        F.col("cluster_id").asc())
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)


def build_clusters(members: DataFrame, by: tuple[str, ...] = ("product",),
                   k: int = REPRESENTATIVES_PER_CLUSTER) -> DataFrame:
    """One nested row per cluster: size, mean, representatives, centroid."""
    cents = centroids(members, by)
    reps = representatives(member_distances(members, cents, by), k, by)
    rep_cols = [c for c in ("doc_id", "seq", "rating", "text", "thumbs_up", "app_version") if c in reps.columns]
    nested = (reps.groupBy(*by, "cluster_id")
              .agg(F.array_sort(F.collect_list(F.struct("rank", *rep_cols))).alias("representatives")))
    return (cluster_stats(members, by).join(nested, [*by, "cluster_id"], "left")
            .join(cents, [*by, "cluster_id"], "left"))
