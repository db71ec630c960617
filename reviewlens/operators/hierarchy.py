"""Density clusters without a distance: spanning forest, condensed tree, excess of mass.

All steps are rounds of joins and aggregations over a neighbour graph, each
ended by a table in the shared folder; no task works on more than a block.

1. Links weigh the greatest of both core distances and their own length. The
   minimum spanning forest takes each component's least link, round by round.
2. Components below the least cluster size merge along links that are the
   least of both sides, at most as many rounds as that size. Once a component
   is large enough, the small ones whose chain of least links leads to it fall
   to it, each at its own link's weight, all in one round: along such a chain
   weights fall, so whatever lies between has joined before.
3. What is left is a tree of cluster cores, fewer than points by the cluster
   size. Its links merge in ascending order, block by block: a block has a
   fixed number of links, whatever the clusters' nesting, and is one task's
   work; points find the cluster they fall out of by doubling. Then, in the
   same blocks, a cluster that ends adds up its stability and is chosen if
   that is no less than what its children have.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.fixed_values import MIN_CLUSTER_SIZE, MIN_SAMPLES, NOISE_LABEL
from reviewlens.sources.shared import shared_folder, stored

LEAST = 1e-9  # distances below count as this
MAX_ROUNDS = 10_000
BLOCK = 1 << 16  # links of the tree of cores that one task merges


def core_distances(graph: DataFrame, sizes: DataFrame, min_samples: int) -> DataFrame:
    """(id, core): the distance within which a node has ``min_samples`` other points, copies included.

    ``graph`` (node, other, d) has a fixed number of links a node, ``sizes``
    (id, n) how many points each node stands for. Nodes with fewer points
    around them in the graph have no row.
    """
    near = graph.join(sizes.select(F.col("id").alias("other"), "n"), "other")
    held = F.sum("n").over(Window.partitionBy("node").orderBy("d", "other").rowsBetween(Window.unboundedPreceding, 0))
    enough = near.withColumn("held", held).join(sizes.select(F.col("id").alias("node"), F.col("n").alias("own")), "node")
    reached = enough.filter(F.col("held") + F.col("own") - 1 >= min_samples).groupBy(F.col("node").alias("id")).agg(F.min("d").alias("core"))
    alone = sizes.filter(F.col("n") > min_samples).select("id", F.lit(0.0).alias("core"))
    return reached.union(alone).groupBy("id").agg(F.min("core").alias("core"))


def reachability_links(graph: DataFrame, cores: DataFrame) -> DataFrame:
    """(a, b, w) with a < b: mutual reachability of all linked nodes that have a core distance."""
    once = graph.filter("node <> other").groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).agg(F.min("d").alias("d"))
    return (once.join(cores.select(F.col("id").alias("a"), F.col("core").alias("core_a")), "a")
            .join(cores.select(F.col("id").alias("b"), F.col("core").alias("core_b")), "b")
            .select("a", "b", F.greatest("core_a", "core_b", "d", F.lit(LEAST)).alias("w")))


def _least_links(links: DataFrame) -> DataFrame:
    """(c, to, w, a, b): the least link of every component; ties by (a, b), so chains end in a mutual pair."""
    ways = links.select(F.col("ca").alias("c"), F.col("cb").alias("to"), "w", "a", "b").union(
        links.select(F.col("cb").alias("c"), F.col("ca").alias("to"), "w", "a", "b"))
    return ways.groupBy("c").agg(F.min(F.struct("w", "a", "b", "to")).alias("e")).select("c", "e.*")


def _mutual(pointers: DataFrame) -> DataFrame:
    """Pairs (c, to, w, a, b), c < to, that point at each other."""
    back = pointers.select(F.col("c").alias("to"), F.col("to").alias("c"))
    return pointers.join(back, ["c", "to"]).filter("c < to").select("c", "to", "w", "a", "b")


def _followed(up: DataFrame) -> DataFrame:
    """(c, root) of pointers (c, root) followed to those that point at themselves, by doubling."""
    now = stored(up)
    for _ in range(MAX_ROUNDS):
        ahead = now.select(F.col("c").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(ahead, "root").select("c", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("c", "root")
        now = now.select("c", "root")
    raise RuntimeError("pointers did not settle")


def _relinked(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``links`` between the components that ``roots`` (c, root) joins; of parallel ones the least."""
    left = roots.select(F.col("c").alias("ca"), F.col("root").alias("ra"))
    right = roots.select(F.col("c").alias("cb"), F.col("root").alias("rb"))
    moved = (links.join(left, "ca", "left").join(right, "cb", "left")
             .select(F.coalesce("ra", "ca").alias("x"), F.coalesce("rb", "cb").alias("y"), "w", "a", "b").filter("x <> y"))
    return stored(moved.groupBy(F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb"))
                        .agg(F.min(F.struct("w", "a", "b")).alias("e")).select("ca", "cb", "e.*"))


def spanning_forest(links: DataFrame) -> DataFrame:
    """(a, b, w): the minimum spanning forest of ``links`` (a < b, w), ties by (a, b)."""
    now = stored(links.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "w", "a", "b"))
    found = links.limit(0).select("a", "b", "w")
    while not now.isEmpty():
        pointers = stored(_least_links(now))
        found = found.union(pointers.select("a", "b", "w"))
        heads = _mutual(pointers).select("c", F.col("c").alias("head"))
        up = pointers.join(heads, "c", "left").select("c", F.coalesce("head", "to").alias("root"))
        now = _relinked(now, _followed(up))
    return stored(found.distinct())


def _cores_of_clusters(forest: DataFrame, sizes: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Step 2: (id, n, c, w) of the points that a core ``c`` gets at weight ``w``, and the links left between cores."""
    links = stored(forest.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "w", "a", "b"))
    points = stored(sizes.select("id", "n", F.col("id").alias("c"), F.when(F.col("n") >= least, F.lit(LEAST)).alias("w")))
    for _ in range(MAX_ROUNDS):
        grown = points.groupBy("c").agg(F.sum("n").alias("size"), F.max(F.col("w").isNotNull()).alias("big"))
        pointers = stored(_least_links(links).join(grown, "c"))
        small = pointers.filter("not big")
        if small.isEmpty():
            return points.filter("w is not null"), links
        pairs = _mutual(small).withColumn("head", F.col("c"))
        ends = pairs.select("c", "head").union(pairs.select(F.col("to").alias("c"), "head"))
        up = (pointers.join(ends, "c", "left")
              .select("c", F.when(F.col("big"), F.col("c")).otherwise(F.coalesce("head", "to")).alias("root")))
        roots = _followed(up)
        core = grown.filter("big").select(F.col("c").alias("root"))
        falls = small.join(roots, "c").join(core, "root").select("c", "root", "w", F.lit(True).alias("settled"))
        joint = pairs.select(F.col("c").alias("head"), "to", F.col("w").alias("w")).join(
            grown.select(F.col("c").alias("head"), F.col("size").alias("size_a")), "head").join(
            grown.select(F.col("c").alias("to"), F.col("size").alias("size_b")), "to")
        joint = joint.withColumn("settled", F.col("size_a") + F.col("size_b") >= least)
        merges = joint.select(F.col("head").alias("c"), F.col("head").alias("root"), "w", "settled").union(
            joint.select(F.col("to").alias("c"), F.col("head").alias("root"), "w", "settled"))
        change = stored(falls.union(merges))
        points = stored(points.join(change.withColumnRenamed("w", "at"), "c", "left").select(
            "id", "n", F.coalesce("root", "c").alias("c"), F.coalesce("w", F.when(F.col("settled"), F.col("at"))).alias("w")))
        links = _relinked(links, change.select("c", "root"))
    raise RuntimeError("cores did not settle")


def _in_order(df: DataFrame, *by: str) -> DataFrame:
    """A block of at most about ``BLOCK`` merges as one ascending partition."""
    return df.repartition(1).sortWithinPartitions(*by)


def _merge_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges along ascending links (x, y, w, a, b): (c, up, end) of both sides, then (c, top) of every x and y."""
    above, name, sides, ends = {}, {}, [], []

    def find(c):
        while above[c] != c:
            above[c] = c = above[above[c]]
        return c

    names = None
    for batch in batches:
        names = batch.schema.field("x").type
        x, y, a, b = ([tuple(v.values()) for v in batch.column(c).to_pylist()] if c in "xy" else batch.column(c).to_pylist() for c in "xyab")
        for left, right, w, up in zip(x, y, batch.column("w").to_pylist(), zip(a, b)):
            for c in (left, right):
                name.setdefault(above.setdefault(c, c), c)
            left, right = find(left), find(right)
            if left != right:
                sides += [(name[left], up), (name[right], up)]
                ends += [w, w]
                above[left] = right
                name[right] = up
    if names is None:
        return
    struct = lambda cs: pa.array([None if c is None else dict(zip("ab", c)) for c in cs], names)
    yield pa.RecordBatch.from_arrays(
        [struct([c for c, _ in sides] + list(above)), struct([up for _, up in sides] + [None] * len(above)),
         pa.array(ends + [None] * len(above), pa.float64()), struct([None] * len(sides) + [name[find(c)] for c in above])],
        names=["c", "up", "end", "top"])


def _merges(cores: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """(c, up, end, block) of all clusters of the tree, and the number of blocks; a top has no ``up`` and that number."""
    spark, folder = cores.sparkSession, f"{shared_folder(cores.sparkSession)}/tree-{uuid.uuid4().hex}"
    name = F.struct(F.col("c").alias("a"), F.col("c").alias("b"))
    tops = stored(cores.select("c", name.alias("top")))
    name_type = tops.schema["top"].dataType.simpleString()
    blocks = -(-links.count() // BLOCK)
    order = ["w", "a", "b"]
    if blocks > 1:  # ranges of about one size
        links = stored(links.repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id()))
    for block in range(blocks):
        part = links if blocks == 1 else links.filter(F.col("block") == block)
        left, right = (tops.select(F.col("c").alias(c), F.col("top").alias(x)) for c, x in (("ca", "x"), ("cb", "y")))
        found = stored(_in_order(part.join(left, "ca").join(right, "cb").select("x", "y", *order), *order).mapInArrow(
            _merge_block, f"c {name_type}, up {name_type}, end double, top {name_type}"))
        found.filter("up is not null").select("c", "up", "end", F.lit(block).alias("block")).write.parquet(f"{folder}/{block}")
        moved = found.filter("top is not null").select(F.col("c").alias("top"), F.col("top").alias("now"))
        tops = stored(tops.join(moved, "top", "left").select("c", F.coalesce("now", "top").alias("top")))
    last = tops.select(F.col("top").alias("c")).distinct().select(
        "c", F.lit(None).cast(name_type).alias("up"), F.lit(float("inf")).alias("end"), F.lit(blocks).alias("block"))
    return stored(spark.read.schema(last.schema).parquet(*[f"{folder}/{k}" for k in range(blocks)]).union(last) if blocks else last), blocks


def _homes(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, n, c, w) with ``c`` the first cluster from the point's core upwards that ends beyond ``w``, by doubling."""
    met = stored(points.join(clusters.select("c", "end"), "c").select("id", "n", "c", "w", (F.col("w") < F.col("end")).alias("out")))
    waiting = met.filter("not out").drop("out")
    if waiting.isEmpty():
        return met.drop("out")
    # A jump passes 2^k clusters, the last of which ends at ``most``; ends ascend along the way.
    jump, jumps = stored(clusters.filter("up is not null").select("c", F.col("up").alias("next"), F.col("end").alias("most"))), []
    while not jump.isEmpty():
        jumps.append(jump)
        ahead = jump.select(F.col("c").alias("next"), F.col("next").alias("further"), F.col("most").alias("later"))
        jump = stored(jump.join(ahead, "next").select("c", F.col("further").alias("next"), F.col("later").alias("most")))
    for jump in reversed(jumps):
        waiting = stored(waiting.join(jump, "c", "left").select(
            "id", "n", F.when(F.col("most") <= F.col("w"), F.col("next")).otherwise(F.col("c")).alias("c"), "w"))
    return met.filter("out").drop("out").union(waiting)


def _rounded(x: float) -> float:
    """``x`` as Spark's ``round(x, 9)``."""
    return float(Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) if math.isfinite(x) else x


def _value_block(single: bool):
    """Stability and choice of clusters in the order of their ends, and what the links they end in have gathered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {}
        for batch in batches:
            stable, chosen = [], []
            columns = [batch.column(k).to_pylist() for k in ("c", "up", "end", "density", "n", "held", "split", "below")]
            for c, up, end, density, n, held, split, below in zip(*columns):
                held, split, below = made.pop(tuple(c.values()), (held, split, below))
                total = held + n
                stability = _rounded(density + (held / split if held > 0 else 0.0) - total / end)
                choose = not single and (c["a"] == c["b"] or stability >= below)  # a core has no children
                stable.append(stability), chosen.append(choose)
                if up is not None:
                    name = tuple(up.values())
                    before = made.get(name, (0, end, 0.0))
                    made[name] = (before[0] + total, end, before[2] + (stability if choose else below))
            empty = pa.nulls(len(stable), pa.int64()), pa.nulls(len(stable), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("c"), batch.column("up"), pa.array(stable, pa.float64()), pa.array(chosen, pa.bool_()), empty[0], empty[1], empty[1]],
                names=["c", "up", "stability", "chosen", "held", "split", "below"])
        if made:  # these end in a later block
            kind = batch.schema.field("c").type
            held, split, below = zip(*made.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([dict(zip("ab", c)) for c in made], kind), pa.nulls(len(made), kind), pa.nulls(len(made), pa.float64()),
                 pa.nulls(len(made), pa.bool_()), pa.array(held, pa.int64()), pa.array(split, pa.float64()), pa.array(below, pa.float64())],
                names=["c", "up", "stability", "chosen", "held", "split", "below"])
    return run


def condensed_tree(points: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Step 3: (c, up, stability, chosen) of all clusters, and the (id, c) that each point falls out of.

    A cluster is named by the link that made it, a core by itself twice. The
    top of a component has no ``up``; it can be chosen if there are several.
    """
    name = F.struct(F.col("c").alias("a"), F.col("c").alias("b"))
    clusters, blocks = _merges(points.select("c").distinct(), links)
    homes = stored(_homes(points.select("id", "n", name.alias("c"), "w"), clusters))
    gone = homes.groupBy("c").agg(F.sum(F.col("n") / F.col("w")).alias("density"), F.sum("n").alias("n"))
    rows = stored(clusters.join(gone, "c", "left").na.fill(0, ["n"]).na.fill(0.0, ["density"]))
    name_type = rows.schema["c"].dataType.simpleString()
    schema = f"c {name_type}, up {name_type}, stability double, chosen boolean, held long, split double, below double"
    only = rows.filter("up is null").count() == 1
    found, state = None, points.sparkSession.createDataFrame([], f"c {name_type}, held long, split double, below double")
    for block in range(blocks + 1):
        part = rows.filter(F.col("block") == block).join(state, "c", "left").na.fill(0, ["held"]).na.fill(0.0, ["below"])
        if block < blocks:
            part = _in_order(part.select("*", "up.a", "up.b"), "end", "a", "b")
        done = stored(part.mapInArrow(_value_block(only and block == blocks), schema))
        closed = done.filter("chosen is not null").select("c", "up", "stability", "chosen")
        found = closed if found is None else found.union(closed)
        left = state.join(rows.filter(F.col("block") == block), "c", "left_anti") if block else state
        state = stored(left.union(done.filter("chosen is null").select("c", "held", "split", "below")))
    return stored(found), homes.select("id", "c")


def _topmost(clusters: DataFrame) -> DataFrame:
    """(c, top): the highest chosen cluster at or above each; null if there is none."""
    now = stored(clusters.select("c", "up", F.when(F.col("chosen"), F.col("c")).alias("top")))
    while not now.filter("up is not null").isEmpty():
        above = now.select(F.col("c").alias("up"), F.col("up").alias("further"), F.col("top").alias("higher"))
        now = stored(now.join(above, "up", "left").select(
            "c", F.col("further").alias("up"), F.coalesce("higher", "top").alias("top")))
    return now.select("c", "top")


def density_hierarchy(graph: DataFrame, sizes: DataFrame, min_samples: int = MIN_SAMPLES,
                      min_cluster_size: int = MIN_CLUSTER_SIZE) -> DataFrame:
    """(id, cluster_id) of every row of ``sizes`` (id, n); ``cluster_id`` is the cluster's least id, or -1.

    ``graph`` (node, other, d) holds neighbours and their distances. Nodes
    without ``min_samples`` points around them, small components and points
    that fall out of clusters that are not chosen are noise. A single component's
    top is no cluster. Empty input gives an empty result.
    """
    graph = stored(graph.select("node", "other", "d"))
    links = reachability_links(graph, core_distances(graph, sizes, min_samples))
    points, between = _cores_of_clusters(spanning_forest(links), sizes, min_cluster_size)
    noise = F.lit(NOISE_LABEL).cast(sizes.schema["id"].dataType)
    if points.isEmpty():
        return sizes.select("id", noise.alias("cluster_id"))
    clusters, homes = condensed_tree(points, between)
    named = stored(homes.join(_topmost(clusters), "c").filter("top is not null").select("id", "top"))
    labels = named.join(named.groupBy("top").agg(F.min("id").alias("cluster_id")), "top").select("id", "cluster_id")
    return sizes.select("id").join(labels, "id", "left").select("id", F.coalesce("cluster_id", noise).alias("cluster_id"))
