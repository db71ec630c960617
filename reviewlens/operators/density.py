"""Exact density clustering at one distance, without listing all pairs of a group.

Points with at least ``min_samples`` others within ``eps`` are core; core
points within ``eps`` of each other are linked, and connected components of
enough points are clusters. The work is done on grid cells whose diagonal is
at most ``eps``: points of one cell are all within ``eps`` of each other, and
a cell has a number of cells in reach that depends on the dimensions alone.
Two cells are linked by one witness, found by halving their boxes; box pairs
that are wholly within reach, or wholly out of it, are decided without their
points.
"""

from __future__ import annotations

from itertools import product
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.fixed_values import MIN_CLUSTER_SIZE, MIN_SAMPLES, NOISE_LABEL
from reviewlens.operators.components import components
from reviewlens.sources.shared import checkpointed

LEVELS = 52  # halvings after which doubles of a cell differ no more


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _square(x: Column) -> Column:
    return x * x


def _gap(dims: int, a: str, b: str) -> Column:
    """Squared distance of the nearest points of two boxes, ``{a}lo``..``{a}hi`` and ``{b}lo``..``{b}hi``."""
    at = lambda name, i: F.get(F.col(name), F.lit(i))
    return _sum([_square(F.greatest(F.lit(0.0), at(f"{b}lo", i) - at(f"{a}hi", i), at(f"{a}lo", i) - at(f"{b}hi", i)))
                 for i in range(dims)])


def _span(dims: int, a: str, b: str) -> Column:
    """Squared distance of the farthest corners of two boxes."""
    at = lambda name, i: F.get(F.col(name), F.lit(i))
    return _sum([_square(F.greatest(F.abs(at(f"{b}hi", i) - at(f"{a}lo", i)), F.abs(at(f"{a}hi", i) - at(f"{b}lo", i))))
                 for i in range(dims)])


def _box(dims: int) -> list[Column]:
    at = lambda i: F.get("vec", F.lit(i))
    return [F.array(*[F.min(at(i)) for i in range(dims)]).alias("lo"), F.array(*[F.max(at(i)) for i in range(dims)]).alias("hi")]


def _side(cells: DataFrame, name: str, by: list[str]) -> DataFrame:
    return cells.select(*by, *[F.col(c).alias(f"{name}{c}") for c in cells.columns if c not in by])


def _reachable(cells: DataFrame, dims: int, eps: float, by: list[str]) -> DataFrame:
    """Ordered pairs of different cells whose boxes are within ``eps``; columns start with a or b."""
    block = ceil(sqrt(dims))  # so many cells are at least eps wide
    coarse = cells.withColumn("coarse", F.transform("cell", lambda c: F.floor(c / block)))
    steps = F.array(*[F.array(*map(F.lit, step)) for step in product((-1, 0, 1), repeat=dims)])
    near = _side(coarse, "a", by).withColumn("step", F.explode(steps)).withColumn(
        "bcoarse", F.zip_with("acoarse", "step", lambda c, s: c + s)).drop("acoarse", "step")
    return (near.join(_side(coarse, "b", by), [*by, "bcoarse"]).drop("bcoarse").filter("acell <> bcell")
            .filter(_gap(dims, "a", "b") <= eps * eps).withColumn("sure", _span(dims, "a", "b") <= eps * eps))


def _core_points(nodes: DataFrame, dims: int, eps: float, min_samples: int, by: list[str]) -> DataFrame:
    """The distinct vectors of ``nodes`` that are core; a cell of more than ``min_samples`` points is core throughout."""
    cells = checkpointed(nodes.groupBy(*by, "cell").agg(F.sum("n").alias("n"), *_box(dims)))
    pairs = checkpointed(_reachable(cells.filter(F.col("n") <= min_samples).select(*by, "cell", "lo", "hi", "n")
                                    .withColumn("sparse", F.lit(True))
                                    .unionByName(cells.filter(F.col("n") > min_samples).withColumn("sparse", F.lit(False))),
                                    dims, eps, by).filter("asparse").select(*by, "acell", "bcell", "bn", "sure"))
    own = nodes.join(cells.select(*by, "cell", F.col("n").alias("in_cell")), [*by, "cell"])
    sparse = own.filter(F.col("in_cell") <= min_samples)
    whole = pairs.filter("sure").groupBy(*by, F.col("acell").alias("cell")).agg(F.sum("bn").alias("sure_n"))
    others = nodes.select(*by, F.col("cell").alias("bcell"), F.col("vec").alias("other"), F.col("n").alias("other_n"))
    distance = _sum([_square(F.get("vec", F.lit(i)) - F.get("other", F.lit(i))) for i in range(dims)])
    part = (sparse.withColumnRenamed("cell", "acell").join(pairs.filter("not sure"), [*by, "acell"])
            .join(others, [*by, "bcell"]).filter(distance <= eps * eps)
            .groupBy(*by, F.col("acell").alias("cell"), "vec").agg(F.sum("other_n").alias("part_n")))
    total = F.col("in_cell") + F.coalesce("sure_n", F.lit(0)) + F.coalesce("part_n", F.lit(0))
    counted = sparse.join(whole, [*by, "cell"], "left").join(part, [*by, "cell", "vec"], "left").filter(total > min_samples)
    return counted.select(nodes.columns).unionByName(own.filter(F.col("in_cell") > min_samples).select(nodes.columns))


def _links(core: DataFrame, dims: int, eps: float, side: float, by: list[str]) -> DataFrame:
    """Pairs (acell, bcell) of cells that hold core points within ``eps`` of each other."""
    names = [*by, "acell", "bcell"]
    cells = checkpointed(core.groupBy(*by, "cell").agg(*_box(dims)))
    pairs = checkpointed(_reachable(cells, dims, eps, by).filter("acell < bcell"))
    links = pairs.filter("sure").select(names)
    open_pairs = pairs.filter("not sure").select(*names, F.col("acell").alias("asub"), F.col("bcell").alias("bsub"))
    for level in range(1, LEVELS + 1):
        if open_pairs.isEmpty():
            return links
        scale = lambda n: F.transform("vec", lambda x: F.floor(x * (2.0 ** n / side)))
        boxes = core.withColumn("sub", scale(level - 1)).withColumn("next", scale(level)).groupBy(
            *by, "cell", "sub", "next").agg(*_box(dims))
        split = (open_pairs.join(_side(boxes, "a", by), [*by, "acell", "asub"]).join(_side(boxes, "b", by), [*by, "bcell", "bsub"])
                 .filter(_gap(dims, "a", "b") <= eps * eps).withColumn("sure", _span(dims, "a", "b") <= eps * eps)
                 .select(*names, F.col("anext").alias("asub"), F.col("bnext").alias("bsub"), "sure"))
        split = checkpointed(split)
        found = split.filter("sure").select(names).distinct()
        links = links.unionByName(found)
        open_pairs = split.filter("not sure").drop("sure").join(found, names, "left_anti")
    raise RuntimeError(f"cells undecided after {LEVELS} halvings")


def density_components(points: DataFrame, eps: float, dims: int, min_samples: int = MIN_SAMPLES,
                       min_cluster_size: int = MIN_CLUSTER_SIZE, key: str = "id", vec: str = "reduced",
                       by: tuple[str, ...] = ()) -> DataFrame:
    """``points`` with ``cluster_id``, the smallest ``key`` of the cluster, or -1 for noise.

    Points that are not core, whose component has fewer than
    ``min_cluster_size`` points, or whose vector is null or has not ``dims``
    finite numbers are noise. Equal vectors are one weighted point. Groups
    (``by``) are clustered apart, in one job.
    """
    if eps <= 0 or dims < 1:
        raise ValueError("eps must be positive and dims at least 1")
    by, side = list(by), eps / sqrt(dims) * (1 - 1e-9)
    value = F.col(vec).cast("array<double>")
    usable = F.coalesce((F.size(value) == dims) & F.forall(value, lambda x: F.abs(x) < 2.0 ** 9 * side), F.lit(False))
    far = points.select(F.max(F.when(F.size(value) == dims, F.array_max(F.filter(F.transform(value, F.abs), lambda x: ~F.isnan(x)
                                                                                  & (x < float("inf"))))))).first()[0]
    if far is not None and far >= 2.0 ** 9 * side:
        raise ValueError(f"coordinates up to {far} need an eps above {far * sqrt(dims) / 2 ** 9}")
    placed = points.withColumn("vec", F.when(usable, value)).withColumn(
        "cell", F.transform("vec", lambda x: F.floor(x * (1.0 / side))))
    nodes = checkpointed(placed.filter("vec is not null").groupBy(*by, "cell", "vec").agg(
        F.count("*").alias("n"), F.min(key).alias("first")))
    core = checkpointed(_core_points(nodes, dims, eps, min_samples, by))
    links = _links(core, dims, eps, side, by)
    node = lambda cell: F.struct(*by, F.col(cell).alias("cell"))
    roots = components(links.select(node("acell").alias("a"), node("bcell").alias("b")))
    cells = core.groupBy(*by, "cell").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    rooted = cells.withColumn("node", node("cell")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.sum("n").alias("size"), F.min("first").alias("cluster_id")).filter(
        F.col("size") >= min_cluster_size)
    labels = rooted.join(named.select("root", "cluster_id"), "root").select(*by, "cell", "cluster_id")
    found = core.select(*by, "cell", "vec").join(labels, [*by, "cell"])
    return (placed.join(found, [*by, "cell", "vec"], "left")
            .withColumn("cluster_id", F.coalesce(F.col("cluster_id"), F.lit(NOISE_LABEL).cast(points.schema[key].dataType)))
            .drop("cell", "vec"))
