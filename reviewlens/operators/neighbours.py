"""K nearest neighbours by descent along a neighbour graph, without an all-pairs join.

Neighbours of neighbours are likely neighbours. The graph starts from random
buckets of fixed size; in every round each node introduces a fixed number of
its neighbours, in either direction, to each other, and every node keeps its
best few. A hub, near to very many nodes, introduces no more than others: its
links are thinned before they move. Equal vectors are one node, so copies cost
nothing and come back when the result is spread over the rows.

The result is approximate; ``recall`` measures it against brute force for a
stated set of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.sources.shared import checkpointed
from reviewlens.sources.tables import spread

BUCKET = 24  # nodes of a random bucket of the start
STARTS = 2  # random buckets that each node is in
SETTLED = 0.005  # share of new links at which the descent ends
DIGITS = 9
MOST_QUERIES = 100_000  # brute-force queries that are sent to every task
POINTS, QUERIES = 4096, 256  # points and queries that are compared in one matrix


def unit_vector(vec: Column, dims: int) -> Column:
    """``vec`` at length one; null unless it has ``dims`` finite numbers and a length."""
    value = vec.cast("array<double>")
    length = F.sqrt(F.aggregate(value, F.lit(0.0), lambda acc, x: acc + x * x))
    usable = (F.size(value) == dims) & F.forall(value, lambda x: F.abs(x) < float("inf")) & (length > 0)
    return F.when(usable, F.transform(value, lambda x: x / length))


def _introduced(lists: DataFrame, dims: int, most: int, euclidean: bool) -> DataFrame:
    """(node, other, d): for every list of ``peers`` the pairs with a fresh member that may enter a node's best ``most``.

    A list has a fixed number of members. Of a pair each side is emitted if it
    is nearer than that side's ``bar``, its farthest kept neighbour.
    """
    id_type = lists.schema["peers"].dataType.elementType["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            peers = batch.column("peers")
            edge = peers.offsets.to_numpy() - peers.offsets[0].as_py()
            flat = peers.flatten()
            ids, fresh = flat.field("id"), flat.field("fresh").to_numpy(zero_copy_only=False)
            bars = flat.field("bar").to_numpy(zero_copy_only=False)
            vectors = flat.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            left, right, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for a, b in zip(edge[:-1], edge[1:]):
                if b - a < 2 or not fresh[a:b].any():
                    continue
                own = vectors[a:b]
                d = 1.0 - own @ own.T
                if euclidean:
                    squares = (own * own).sum(axis=1)
                    d = np.sqrt(np.maximum(squares[:, None] + squares[None] - 2 * (own @ own.T), 0.0))
                d = np.round(d, DIGITS)
                fits = (d < bars[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b])
                np.fill_diagonal(fits, False)
                if b - a > most + 1:  # a node takes no more than its best few from one list
                    ranked = np.argsort(np.where(fits, d, np.inf), axis=1, kind="stable")[:, most:]
                    np.put_along_axis(fits, ranked, False, axis=1)
                i, j = np.nonzero(fits)
                left.append(i + a), right.append(j + a), far.append(d[i, j])
            left, right = pa.array(np.concatenate(left)), pa.array(np.concatenate(right))
            yield pa.RecordBatch.from_arrays([ids.take(left), ids.take(right), pa.array(np.concatenate(far))],
                                             names=["node", "other", "d"])

    return lists.select("peers").mapInArrow(run, f"node {id_type}, other {id_type}, d double")


def _best(links: DataFrame, most: int) -> DataFrame:
    """The nearest ``most`` of every node, each pair once; a link that was there before is not fresh."""
    once = links.groupBy("node", "other").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("d", "other"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= most)


def descend(nodes: DataFrame, dims: int, degree: int = 20, introduce: int = 24, max_rounds: int = 12,
            euclidean: bool = False) -> DataFrame:
    """(node, other, d, rank): about the ``degree`` nearest of each row of ``nodes`` (id, vec).

    Distances are cosine distances of unit vectors, or Euclidean.

    Every round moves ``introduce`` vectors for each node at most and ends in a
    reliable checkpoint. It stops when hardly a link is new.
    """
    n = nodes.count()
    buckets = max(1, n // BUCKET)
    seeds = F.explode(F.array(*map(F.lit, range(STARTS))))
    start = (nodes.withColumn("seed", seeds)
             .groupBy("seed", F.pmod(F.xxhash64("id", "seed"), F.lit(buckets)).alias("bucket"))
             .agg(F.collect_list(F.struct("id", "vec", F.lit(float("inf")).alias("bar"), F.lit(True).alias("fresh"))).alias("peers")))
    graph = checkpointed(_best(_introduced(start, dims, degree, euclidean).withColumn("fresh", F.lit(True)), degree))
    for step in range(max_rounds):
        bars = graph.groupBy("node").agg(F.max("d").alias("d"), F.count("*").alias("n"))
        known = nodes.join(bars, nodes["id"] == bars["node"], "left").select(
            "id", "vec", F.when(F.col("n") >= degree, F.col("d")).otherwise(F.lit(float("inf"))).alias("bar"))
        both = graph.select("node", "other", "fresh").union(graph.select(
            F.col("other").alias("node"), F.col("node").alias("other"), "fresh")).groupBy("node", "other").agg(
            F.max("fresh").alias("fresh"))  # a pair that holds both ways counts once
        order = [F.desc("fresh"), F.xxhash64("node", "other", F.lit(step)), "other"]
        some = (both.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy(*order)))
                .filter(F.col("at") <= introduce).select("node", F.col("other").alias("id"), "fresh"))
        met = some.join(known, "id").groupBy("node").agg(F.collect_list(F.struct("id", "vec", "bar", "fresh")).alias("peers"))
        found = _introduced(met, dims, degree, euclidean).withColumn("fresh", F.lit(True))
        graph = checkpointed(_best(graph.select("node", "other", "d", F.lit(False).alias("fresh")).union(found), degree))
        if graph.filter("fresh").count() <= SETTLED * n * degree:
            break
    return graph.drop("fresh")


def classes(points: DataFrame, dims: int, key: str, vec: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct unit vectors (id, vec, members: the least ``k`` + 1 keys) and each row's (key, id).

    Rows whose vector is null, of another length, without a length or not finite are in neither.
    """
    unit = F.transform(unit_vector(F.col(vec), dims), lambda x: F.round(x, 12) + F.lit(0.0))  # no negative zero
    rows = points.select(F.col(key).alias("key"), unit.alias("vec")).filter("key is not null and vec is not null")
    least = F.row_number().over(Window.partitionBy("vec").orderBy("key"))
    members = rows.distinct().withColumn("at", least).filter(F.col("at") <= k + 1).groupBy("vec").agg(
        F.min("key").alias("id"), F.array_sort(F.collect_list("key")).alias("members"))
    nodes = checkpointed(members)
    return nodes, rows.distinct().join(nodes.select("vec", "id"), "vec").select("key", "id")


def knn_graph(points: DataFrame, k: int = 5, dims: int = 64, key: str = "vec_id", vec: str = "embedding",
              degree: int | None = None) -> DataFrame:
    """(key, rank, neighbour, distance): the ``k`` nearest other keys by cosine distance, ties by key.

    Rows with equal keys count once. Rows without a usable vector or without a
    key have no neighbours and are nobody's. Approximate, see the module.
    """
    nodes, rows = classes(points, dims, key, vec, k)
    graph = descend(nodes, dims, degree or max(4 * k, 16))
    around = graph.select("node", F.col("other").alias("id"), "d").union(nodes.select(F.col("id").alias("node"), "id", F.lit(0.0)))
    near = (around.join(nodes.select("id", "members"), "id")
            .select("node", F.explode("members").alias("neighbour"), "d"))
    least = F.row_number().over(Window.partitionBy("node").orderBy("d", "neighbour"))
    lists = near.withColumn("at", least).filter(F.col("at") <= k + 1).groupBy(F.col("node").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("d").alias("distance"), "neighbour"))).alias("near"))
    own = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("key")), 1, k)
    return (rows.join(lists, "id").select("key", F.posexplode(own).alias("pos", "x"))
            .select(F.col("key").alias(key), (F.col("pos") + 1).cast("long").alias("rank"), "x.neighbour", "x.distance"))


def _distance(q: np.ndarray, p: np.ndarray, i: np.ndarray, j: np.ndarray, squares: bool) -> np.ndarray:
    """Distances of the pairs (q[i], p[j]), added up in the order of the coordinates."""
    total = np.zeros(len(i))
    for a, b in zip(q.T, p.T):
        total += (b[j] - a[i]) ** 2 if squares else b[j] * a[i]
    return total if squares else np.round(1.0 - total, DIGITS)


def _nearer(best: tuple[np.ndarray, np.ndarray], asked: np.ndarray, q: np.ndarray, keys: np.ndarray, p: np.ndarray,
            squares: bool) -> tuple[np.ndarray, np.ndarray]:
    """``best`` (distances, keys) of each query in ``q``, ascending by both, with the points ``p`` taken in.

    A matrix product leaves the pairs that can be among the best, with room for
    its rounding; these are measured one by one.
    """
    far, near = best
    k = far.shape[1]
    rough = q @ p.T
    if squares:
        a, b = (q * q).sum(axis=1), (p * p).sum(axis=1)
        rough = a[:, None] + b[None] - 2 * rough
        room = 1e-12 * (a + b.max())
    else:
        rough, room = 1.0 - rough, np.full(len(q), 4 * 10.0 ** -DIGITS)
    rough[asked[:, None] == keys[None]] = np.inf
    bar = far[:, -1] if rough.shape[1] < k else np.minimum(far[:, -1], np.partition(rough, k - 1, axis=1)[:, k - 1])
    i, j = np.nonzero((rough <= (bar + room)[:, None]) & (rough < np.inf))
    row = np.concatenate([np.repeat(np.arange(len(q)), k), i])
    d = np.concatenate([far.ravel(), _distance(q, p, i, j, squares)])
    key = np.concatenate([near.ravel(), keys[j]])
    order = np.lexsort((key, d, row))
    row = row[order]
    start = np.searchsorted(row, np.arange(len(q)))
    first = order[start[:, None] + np.arange(k)]  # every row has at least its k places of before
    return d[first], key[first]


def nearest(queries: DataFrame, points: DataFrame, k: int, squares: bool = False) -> DataFrame:
    """(query, near): the ``k`` nearest keys of a stated, small query set, by brute force over all ``points``.

    ``queries`` (query, q) are counted and sent to every task, which holds
    ``k`` keys of each while it goes through its ``points`` (key, p). Distances
    are cosine distances of unit vectors, rounded, or ``squares`` of Euclidean
    distances; ties go by key. Keys are longs.
    """
    if queries.count() > MOST_QUERIES:
        raise ValueError(f"state {MOST_QUERIES} queries at most")
    table = queries.select(F.col("query").cast("long"), F.col("q").cast("array<double>")).toArrow().combine_chunks()
    asked = table.column("query").to_numpy()
    q = np.array(table.column("q").to_pylist(), np.float64).reshape(len(asked), -1 if len(asked) else 0)
    sent = queries.sparkSession.sparkContext.broadcast((asked, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q = sent.value
        far, near = np.full((len(asked), k), np.inf), np.zeros((len(asked), k), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows if len(asked) else 0, POINTS):
                batch = whole.slice(at, POINTS)
                keys = batch.column("key").to_numpy()
                p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(len(keys), q.shape[1])
                for x in range(0, len(asked), QUERIES):
                    part = slice(x, x + QUERIES)
                    far[part], near[part] = _nearer((far[part], near[part]), asked[part], q[part], keys, p, squares)
        held = far < np.inf
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, k)[held.ravel()]), pa.array(near[held]), pa.array(far[held])],
                                         names=["query", "key", "d"])

    pairs = spread(points.select(F.col("key").cast("long"), F.col("p").cast("array<double>")).dropna()).mapInArrow(
        run, "query long, key long, d double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "key"))
    return (pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
            .groupBy("query").agg(F.array_sort(F.collect_list("key")).alias("near")))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query, kept): the share of ``exact`` (query, near) that ``found`` (query, near) holds."""
    other = found.select("query", F.col("near").alias("found"))
    hits = F.size(F.array_intersect("near", F.coalesce("found", F.array().cast(exact.schema["near"].dataType))))
    return exact.join(other, "query", "left").select("query", (hits / F.size("near")).alias("kept"))
