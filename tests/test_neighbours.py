"""Neighbour graph, reduction and hierarchy against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from reviewlens.operators import hierarchy, neighbours, spectral


def blobs(sizes, dims, seed, spread=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(len(sizes), dims))
    return np.concatenate([c + spread * (1 + i) * rng.normal(size=(n, dims)) for i, (c, n) in enumerate(zip(centres, sizes))])


def distances(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 9)
    np.fill_diagonal(d, 9)
    return d


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def full_graph(spark, d):
    n = len(d)
    return spark.createDataFrame([(i, j, float(d[i, j])) for i in range(n) for j in range(n) if i != j], "node long, other long, d double")


# ------------------------------------------------------------------ graph ----

def test_recall_on_given_vectors(spark):
    vectors = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    got = {}
    for r in neighbours.knn_graph(vectors, 5).collect():
        got.setdefault(r.vec_id, []).append(r)
    ids, x = zip(*sorted((r.vec_id, r.embedding) for r in vectors.collect()))
    d = distances(np.array(x, float))
    hits = 0
    for i, own in enumerate(np.argsort(d, axis=1, kind="stable")[:, :5]):
        rows = sorted(got[ids[i]], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5] and ids[i] not in {r.neighbour for r in rows}
        assert all(abs(r.distance - d[i, ids.index(r.neighbour)]) < 1e-8 for r in rows)
        hits += len({ids[j] for j in own} & {r.neighbour for r in rows})
    assert hits >= 0.9 * 5 * len(ids)


def test_copies_odd_vectors_and_repeated_rows(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(40)] + [(100, [0.0, 1.0, 0.0]), (101, [0.0, 1.0, 0.1]), (101, [0.0, 1.0, 0.1])]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0]), (203, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    got = {}
    for r in neighbours.knn_graph(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3, 3).collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.neighbour))
    assert set(got) == {*range(40), 100, 101}
    assert [n for _, n in sorted(got[0])] == [1, 2, 3] and [n for _, n in sorted(got[2])] == [0, 1, 3]
    assert [n for _, n in sorted(got[101])] == [100, 0, 1]
    assert neighbours.knn_graph(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_hub_is_thinned_not_dropped(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([[np.ones(6)], np.ones(6) + 0.5 * rng.normal(size=(300, 6))])  # one vector near to all others
    got = {}
    for r in neighbours.knn_graph(frame(spark, x), 4, 6).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour)
    exact = np.argsort(distances(x), axis=1, kind="stable")[:, :4]
    assert np.mean([len(got[i] & set(e.tolist())) / 4 for i, e in enumerate(exact)]) >= 0.95


@pytest.mark.parametrize("squares", [False, True])
def test_brute_force_is_exact_with_copies_ties_and_repeated_keys(spark, monkeypatch, squares):
    monkeypatch.setattr(neighbours, "POINTS", 7), monkeypatch.setattr(neighbours, "QUERIES", 3)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4))
    x[20:50] = x[20]  # copies: ties go by key
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist()), (10, x[10].tolist())]
    points = spark.createDataFrame(rows, "key long, p array<double>").repartition(3)
    asked = [r for r in rows if r[0] % 10 == 0]
    got = {r["query"]: r["near"] for r in neighbours.nearest(
        spark.createDataFrame(asked, "query long, q array<double>"), points, 4, squares).collect()}
    exact = {}
    for query, q in asked:
        for key, p in rows:
            if key != query:
                d = sum((a - b) ** 2 for a, b in zip(p, q)) if squares else round(1 - sum(a * b for a, b in zip(p, q)), 9)
                exact.setdefault(query, []).append((d, key))
    assert got == {query: sorted(key for _, key in sorted(pairs)[:4]) for query, pairs in exact.items()}


def test_brute_force_makes_no_row_for_a_pair(spark):
    points = spark.range(3000).select(F.col("id").alias("key"), F.array(F.sin("id"), F.cos("id")).alias("p"))
    queries = points.filter("key % 100 = 0").select(F.col("key").alias("query"), F.col("p").alias("q"))
    found = neighbours.nearest(queries, points, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and found.count() == 30
    none = points.limit(0)
    assert neighbours.nearest(queries, none, 5).collect() == [] and neighbours.nearest(queries.limit(0), points, 5).collect() == []


# -------------------------------------------------------------- reduction ----

def test_reduction_keeps_more_neighbours_than_signs(spark):
    x = blobs([40] * 6, 16, 1, 0.3)
    nodes = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    d = distances(x)
    near = np.argsort(d, axis=1, kind="stable")[:, :15]
    graph = spark.createDataFrame([(i, int(j)) for i, own in enumerate(near) for j in own], "node long, other long")
    reduced = {r.id: r.reduced for r in spectral.spectral_reduce(nodes, graph, 16).collect()}
    again = {r.id: r.reduced for r in spectral.spectral_reduce(nodes, graph, 16).collect()}
    assert len(reduced) == len(x) and all(len(v) == 5 for v in reduced.values())
    y = np.array([reduced[i] for i in range(len(x))])
    assert np.allclose(y, [again[i] for i in range(len(x))], atol=1e-6)
    signs = np.array([[(-1) ** (i & m).bit_count() for i in range(16)] for m in spectral.START_MASKS[:5]])

    def kept(z):
        e = ((z[:, None] - z[None]) ** 2).sum(2)
        np.fill_diagonal(e, 1e9)
        return np.mean([len(set(a[:5]) & set(b[:5])) / 5 for a, b in zip(near, np.argsort(e, axis=1, kind="stable"))])

    assert kept(y) > kept(x / np.linalg.norm(x, axis=1, keepdims=True) @ signs.T)


def test_reduction_of_nothing(spark):
    nodes = spark.createDataFrame([], "id long, vec array<double>")
    graph = spark.createDataFrame([], "node long, other long")
    assert spectral.spectral_reduce(nodes, graph, 4).collect() == []


# -------------------------------------------------------------- hierarchy ----

def brute_links(d, sizes, min_samples):
    n, out = len(d), []
    core = {}
    for i in range(n):
        held = sizes[i] - 1
        if held >= min_samples:
            core[i] = 0.0
            continue
        for j in sorted(range(n), key=lambda j: (d[i, j], j)):
            if j != i:
                held += sizes[j]
                if held >= min_samples:
                    core[i] = d[i, j]
                    break
    return sorted((max(core[i], core[j], d[i, j], hierarchy.LEAST), i, j) for i in core for j in core if i < j)


def brute_hierarchy(d, sizes, min_samples, least):
    """One merge at a time in the order of weight, then condensed and chosen by recursion."""
    n, links = len(d), brute_links(d, sizes, min_samples)
    parent, node_of, tree, weight = list(range(n)), {}, {}, 0.0

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        node_of[i], tree[i] = i, (None, None, None, sizes[i], [i])
    new = n
    for w, i, j in links:
        a, b = find(i), find(j)
        if a != b:
            weight += w
            x, y = node_of[a], node_of[b]
            tree[new] = (x, y, w, tree[x][3] + tree[y][3], tree[x][4] + tree[y][4])
            parent[a] = b
            node_of[b] = new
            new += 1
    tops = [t for t in {node_of[find(i)] for i in range(n)} if tree[t][3] >= least]
    labels = {i: -1 for i in range(n)}

    def walk(t, birth, top):
        """(value, clusters) of the condensed cluster that starts with dendrogram node t at distance ``birth``."""
        total, at, split, members = 0.0, t, None, tree[t][4]
        while True:
            x, y, w, size, ids = tree[at]
            if x is None:  # a point that is a cluster by its copies
                total += size * (1 / hierarchy.LEAST - 1 / birth)
                break
            big = [c for c in (x, y) if tree[c][3] >= least]
            if len(big) == 2:
                total += size * (1 / w - 1 / birth)
                split = (x, y, w)
                break
            if not big:
                total += size * (1 / w - 1 / birth)
                break
            other = y if big[0] == x else x
            total += tree[other][3] * (1 / w - 1 / birth)
            at = big[0]
        if split is None:
            return total, ([] if top else [members])
        (v1, c1), (v2, c2) = (walk(c, split[2], False) for c in split[:2])
        if not top and round(total, 9) >= v1 + v2:
            return total, [members]
        return v1 + v2, c1 + c2

    for t in tops:
        for members in walk(t, float("inf"), len(tops) == 1)[1]:
            for i in members:
                labels[i] = min(members)
    return labels, weight


@pytest.mark.parametrize("seed,sizes", [(1, [25, 20, 18]), (4, [14, 13, 12, 11])])
def test_hierarchy_equals_brute_force(spark, seed, sizes):
    x = blobs(sizes, 4, seed, 0.08)
    d = distances(x)
    expected, weight = brute_hierarchy(d, [1] * len(x), 3, 6)
    graph = full_graph(spark, d)
    ones = spark.createDataFrame([(i, 1) for i in range(len(x))], "id long, n long")
    forest = hierarchy.spanning_forest(hierarchy.reachability_links(graph, hierarchy.core_distances(graph, ones, 3)))
    assert abs(forest.agg(F.sum("w")).first()[0] - weight) < 1e-9 and forest.count() == len(x) - 1
    got = {r.id: r.cluster_id for r in hierarchy.density_hierarchy(graph, ones, 3, 6).collect()}
    assert got == expected
    assert len(set(got.values()) - {-1}) > 1


def test_copies_count_as_points(spark):
    x = blobs([12, 12], 3, 7, 0.1)
    d, sizes = distances(x), [9, 1] * 6 + [1] * 12
    weighted = spark.createDataFrame(list(enumerate(sizes)), "id long, n long")
    got = {r.id: r.cluster_id for r in hierarchy.density_hierarchy(full_graph(spark, d), weighted, 4, 8).collect()}
    assert got == brute_hierarchy(d, sizes, 4, 8)[0]


def test_separate_components_and_too_few_points(spark):
    graph = spark.createDataFrame([(a + o, b + o, abs(a - b) / 10) for o in (0, 100) for a in range(8) for b in range(8) if a != b]
                                  + [(500, 501, 0.1), (501, 500, 0.1)], "node long, other long, d double")
    ones = spark.createDataFrame([(i, 1) for i in [*range(8), *range(100, 108), 500, 501, 900]], "id long, n long")
    got = {r.id: r.cluster_id for r in hierarchy.density_hierarchy(graph, ones, 2, 5).collect()}
    assert {got[i] for i in range(8)} == {0} and {got[i] for i in range(100, 108)} == {100}
    assert {got[i] for i in (500, 501, 900)} == {-1}
    nothing = spark.createDataFrame([], "id long, n long")
    assert hierarchy.density_hierarchy(graph.limit(0), nothing).collect() == []


def test_nested_clusters_need_no_round_each(spark, monkeypatch):
    """A chain of 24 nested clusters: few tables are written, and blocks of any size give the same tree."""
    points = spark.createDataFrame([(c, 3, c, hierarchy.LEAST) for c in range(25)] + [(1000, 1, 0, 20.5), (1001, 2, 24, 30.0)],
                                   "id long, n long, c long, w double")
    links = spark.createDataFrame([(c, c + 1, c + 1.0, c, c + 1) for c in range(24)], "ca long, cb long, w double, a long, b long")
    tables, stored = [], hierarchy.stored
    monkeypatch.setattr(hierarchy, "stored", lambda df: tables.append(0) or stored(df))

    def tree():
        clusters, homes = hierarchy.condensed_tree(points, links)
        return ({tuple(r.c): (r.up and tuple(r.up), r.stability, r.chosen) for r in clusters.collect()},
                {r.id: tuple(r.c) for r in homes.collect()})

    whole = tree()
    assert len(tables) < 24
    clusters, homes = whole
    assert homes[1000] == (19, 20) and homes[1001] == (23, 24) and homes[7] == (7, 7)
    assert all(clusters[c, c + 1][0] == (c + 1, c + 2) for c in range(23)) and clusters[23, 24][0] is None
    assert [c for c, (up, _, _) in clusters.items() if up == (5, 6)] in ([(4, 5), (6, 6)], [(6, 6), (4, 5)])
    below = 3 * 21 + 1  # points at or below the cluster that one falls out of at 20.5
    assert clusters[19, 20][1] == pytest.approx(1 / 20.5 + (below - 1) / 20 - below / 21, abs=1e-9)
    assert not clusters[23, 24][2] and all(clusters[c, c][2] for c in range(25))
    monkeypatch.setattr(hierarchy, "BLOCK", 9)
    assert tree() == whole
