"""Cluster build/rank on tiny fixtures and sequential ids."""

from pyspark.sql import functions as F

from reviewlens.operators import clusters, ids


def _members(spark):
    rows = [("p", 0, 1, [0.0, 0.0], 0), ("p", 1, 2, [0.0, 1.0], 0), ("p", 2, 5, [10.0, 10.0], -1)]
    df = spark.createDataFrame(rows, "product string, seq long, rating int, embedding array<float>, cluster_id int")
    return ids.with_doc_ids(df)


def test_build_clusters_three_points(spark):
    out = clusters.build_clusters(_members(spark)).collect()
    assert len(out) == 1
    c = out[0]
    assert (c.cluster_id, c.size, c.avg_rating) == (0, 2, 1.5)
    assert [r.doc_id for r in c.representatives] == ["doc_0", "doc_1"]
    assert c.centroid == [0.0, 0.5]


def test_rank_clusters_ties(spark):
    stats = spark.createDataFrame([("p", 1, 10, 1.0), ("p", 2, 50, 3.0), ("p", 3, 50, 1.0), ("p", 4, 10, 5.0)],
                                  "product string, cluster_id int, size long, avg_rating double")
    means = spark.createDataFrame([("p", 3.0)], "product string, global_mean double")
    got = [r.cluster_id for r in clusters.rank_clusters(stats, means, top_n=2).orderBy("rank").collect()]
    assert got == [3, 2]
    # equal size and mean -> lower id first
    stats2 = spark.createDataFrame([("p", 7, 5, 2.0), ("p", 6, 5, 2.0)], stats.schema)
    assert [r.cluster_id for r in clusters.rank_clusters(stats2, means).orderBy("rank").collect()] == [6, 7]


def test_representatives_cap_and_ties(spark):
    rows = [("p", i, 3, [1.0, 0.0] if i % 2 else [-1.0, 0.0], 0) for i in range(8)]
    df = spark.createDataFrame(rows, "product string, seq long, rating int, embedding array<float>, cluster_id int")
    reps = clusters.representatives(clusters.member_distances(df, clusters.centroids(df)))
    got = [r.seq for r in reps.orderBy("rank").collect()]
    assert got == [0, 1, 2, 3, 4]  # all equidistant -> arrival order, five kept


def test_sequential_index_across_blocks(spark):
    seqs = [0, 5, 70000, 70001, 200000, 1_000_000_003]
    df = spark.createDataFrame([("a", s) for s in seqs] + [("b", s) for s in seqs[:2]], "product string, seq long")
    out = ids.sequential_index(df, out="i").collect()
    got = {(r.product, r.seq): r.i for r in out}
    assert [got[("a", s)] for s in seqs] == list(range(6))
    assert got[("b", 0)] == 0 and got[("b", 5)] == 1
    named = ids.with_doc_ids(df).filter(F.col("product") == "a").orderBy("seq").collect()
    assert named[0].doc_id == "doc_0" and named[-1].doc_id == "doc_5"
