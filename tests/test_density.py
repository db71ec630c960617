"""Density clustering against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.operators import vectors
from reviewlens.operators.density import density_components


def _brute(points, eps, min_samples, min_size):
    ids, x = [p[0] for p in points], np.array([p[1] for p in points])
    d = np.zeros((len(x), len(x)))
    for i in range(x.shape[1]):
        d += (x[:, None, i] - x[None, :, i]) ** 2
    near = d <= eps * eps
    core = near.sum(1) - 1 >= min_samples
    label, out = {}, {i: -1 for i in ids}
    for s in np.argsort(ids, kind="stable"):
        if not core[s] or s in label:
            continue
        todo, seen = [s], {s}
        while todo:
            at = todo.pop()
            for n in np.flatnonzero(near[at] & core):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        for n in seen:
            label[n] = ids[s]
        if len(seen) >= min_size:
            out |= {ids[n]: ids[s] for n in seen}
    return out


def _found(spark, points, eps, dims, **kw):
    df = spark.createDataFrame(points, "id long, reduced array<double>")
    return {r["id"]: r.cluster_id for r in density_components(df, eps, dims, **kw).collect()}


@pytest.mark.parametrize("dims", [2, 3])
def test_blobs_with_noise(spark, dims):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(c, 0.25, (70, dims)) for c in (0, 1.5, 5)] + [rng.uniform(-3, 8, (40, dims))])
    points = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    points += [(1000 + i, [2.0 + 1e-9] * dims) for i in range(30)]  # copies: one weighted point
    for eps in (0.3, 0.8):
        assert _found(spark, points, eps, dims) == _brute(points, eps, 5, 10)


def test_two_dense_cells_need_a_witness(spark):
    rng = np.random.default_rng(5)
    left, right = rng.uniform(0, 0.3, (60, 1)), rng.uniform(1.0, 1.3, (60, 1))
    points = [(i, [float(v[0])]) for i, v in enumerate(np.concatenate([left, right]))]
    gap = float(right.min() - left.max())
    assert set(_found(spark, points, gap * (1 + 1e-6), 1).values()) == {0}
    assert set(_found(spark, points, gap * (1 - 1e-6), 1).values()) == {0, 60}


def test_nulls_wrong_sizes_and_empty(spark):
    points = [(i, [0.0, 0.0]) for i in range(12)] + [(20, None), (21, [0.0]), (22, [float("nan"), 0.0])]
    got = _found(spark, points, 0.5, 2)
    assert {got[i] for i in range(12)} == {0} and {got[i] for i in (20, 21, 22)} == {-1}
    assert _found(spark, [], 0.5, 2) == {}
    df = spark.createDataFrame(points[:12], "id long, reduced array<double>")
    apart = density_components(df.withColumn("product", F.col("id") % 2), 0.5, 2, min_samples=3, min_cluster_size=6, by=("product",))
    assert {(r["id"] % 2, r.cluster_id) for r in apart.collect()} == {(0, 0), (1, 1)}


def test_sign_projection(spark):
    x = np.random.default_rng(1).normal(size=8)
    df = spark.createDataFrame([([float(v) for v in x],)], "e array<double>")
    got = df.select(vectors.sign_projection(F.col("e"), 8, (0, 5)).alias("p")).first().p
    signs = [(-1) ** (i & 5).bit_count() for i in range(8)]
    assert np.allclose(got, [x.sum(), (x * signs).sum()])


def test_project_terms(spark):
    rows = [("p", 0, "slow app, slow login"), ("p", 1, "slow app, slow login"), ("q", 0, "great charts"), ("q", 1, None),
            ("q", 2, " .. "), ("q", 3, "great app")]
    df = spark.createDataFrame(rows, "product string, seq long, text string")
    got = {(r["product"], r.seq): r.reduced for r in vectors.project_terms(df).collect()}
    assert len(got) == len(rows) and got["p", 0] == got["p", 1]
    assert got["q", 1] == got["q", 2] == [0.0] * 3
    held = {"slow": 2, "app": 3, "login": 2, "great": 2, "charts": 1}
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for t in held], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    w = {t: n * np.log(7 / (held[t] + 1)) for t, n in {"slow": 2, "app": 1, "login": 1}.items()}
    expected = [sum(w[t] * (1 - 2 * (hashes[t] >> i & 1)) for t in w) / np.sqrt(sum(v * v for v in w.values())) for i in range(3)]
    assert np.allclose(got["p", 0], expected, atol=1e-8)
