"""SimHash near-duplicates by covering locality-sensitive hashing.

Texts get a 64-bit SimHash of their word shingles. Bit masks are structured so
that any two fingerprints within the radius agree on all bits of at least one
mask (no false negatives): every bit position gets a vector over GF(2) of
``radius + 1`` coordinates, and mask ``v`` keeps the positions whose vector has
an odd inner product with ``v``. At most ``radius`` differing positions span
fewer than ``radius + 1`` dimensions, so some ``v`` is orthogonal to them all.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.common import checkpointed, map_texts, row_key, small_side, word_blocks
from reviewlens.operators.components import components

BITS = 64
SEED = 42
SMALL_BUCKET = 32


def simhash(text: str | None, width: int) -> int:
    """Signed 64-bit fingerprint of the ``width``-word shingles; 0 without words."""
    digest = xxhash.xxh64_intdigest
    votes, total, tail = np.zeros(BITS, np.int64), 0, []
    for words in word_blocks(text):
        words = tail + words
        hashes = [digest(b" ".join(words[i:i + width]), SEED) for i in range(len(words) - width + 1)]
        tail = words[-(width - 1):] if width > 1 else []
        if hashes:
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little")
            votes += bits.reshape(-1, BITS).sum(axis=0, dtype=np.int64)
            total += len(hashes)
    if not total and tail:
        votes += np.unpackbits(np.array([digest(b" ".join(tail), SEED)], "<u8").view(np.uint8), bitorder="little")
        total = 1
    value = int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0]) if total else 0
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; null and blank texts have fingerprint 0."""
    def start():
        return lambda texts: [pa.array([simhash(t, width) for t in texts], pa.int64())]

    return map_texts(docs.select("doc_id", "text"), [("fp", T.LongType())], start)


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 signed masks over 64 bits that cover every ball of ``radius``."""
    dims = 1 << (radius + 1)
    vector = [1 + i % (dims - 1) for i in range(BITS)]
    masks = [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, dims)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def near_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all pairs within ``radius``.

    Buckets of up to ``SMALL_BUCKET`` fingerprints are compared pair by pair.
    In a larger one each fingerprint is keyed by all points within half the
    radius over the bits its mask leaves free; two fingerprints are within the
    radius exactly if they share such a point, and everyone at a point links
    to the least one there. No bucket emits all its pairs, none is dropped.
    """
    if radius % 2 or not 0 < radius <= 6:
        raise ValueError("radius must be 2, 4 or 6: links run through a midpoint")
    masks = covering_masks(radius)
    rows = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = checkpointed(rows.join(sizes, ["t", "key"]))
    few = members.filter(F.col("n") <= SMALL_BUCKET)
    pairs = (few.select("t", "key", F.col("fp").alias("a"))
             .join(few.select("t", "key", F.col("fp").alias("b")), ["t", "key"])
             .filter(f"a < b and bit_count(a ^ b) <= {radius}").select("a", "b"))
    flips = []
    for m in masks:
        free = [i for i in range(BITS) if not m >> i & 1]
        sets = [c for k in range(radius // 2 + 1) for c in combinations(free, k)]
        flips.append([(s - (1 << BITS) if s >> (BITS - 1) else s) for s in (sum(1 << i for i in c) for c in sets)])
    shifts = fps.sparkSession.createDataFrame(list(enumerate(flips)), "t int, flips array<bigint>")
    points = (members.filter(F.col("n") > SMALL_BUCKET).join(F.broadcast(shifts), "t")  # one row for each mask
              .select("t", "key", "fp", F.explode("flips").alias("flip"))
              .select("t", "key", "fp", F.expr("fp ^ flip").alias("point")))
    least = points.groupBy("t", "key", "point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    stars = (points.join(least, ["t", "key", "point"]).filter("fp <> a").select("a", F.col("fp").alias("b")))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id``
    is the smallest doc_id reachable, itself included. Null and blank texts
    have fingerprint 0 and link like any other. Equal fingerprints (exact
    copies, repeated rows) are one node, so a huge group of copies costs one.
    Rows with a null doc_id keep their fingerprint; they never name a
    component unless it has no other id. An empty table gives no rows.
    """
    rows = checkpointed(fingerprints(docs, width))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(near_links(nodes, radius))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: its smallest doc_id.

    Each row is judged by its own text, so rows that share a doc_id, or have
    none, go only if they are near-duplicates; rows without an id stay only if
    no row of their group has one, and among equal ids a hash of the row
    decides. Of equal rows one stays. Only the keys of rows to drop or to thin
    out are joined to the texts, so few copies mean little to move.
    """
    own = row_key(docs)
    found = near_duplicates(docs.select(
        F.struct(docs["doc_id"].isNull().alias("none"), docs["doc_id"].alias("id"), own.alias("key")).alias("doc_id"), "text"),
        width, radius)
    keys = checkpointed(found.groupBy("doc_id.key").agg(
        F.count("*").alias("rows"), F.max(F.expr("doc_id <=> component_id")).alias("stays")))
    plain = docs.join(small_side(keys.filter("not stays or rows > 1")), own == keys["key"], "left_anti")
    many = keys.filter("stays and rows > 1")
    if many.isEmpty():
        return plain
    whole = F.struct(*[docs[c] for c in docs.columns])
    thinned = docs.join(small_side(many), own == keys["key"]).groupBy(own).agg(F.first(whole).alias("row")).select("row.*")
    return plain.union(thinned)
