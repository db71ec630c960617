"""Document fingerprints: weighted SimHash and search by permuted block tables.

Terms are a text's words and adjacent word pairs; each votes with weight
``16 (1 + ln tf)``, rounded, on the 128 signed bits of its hash. Search splits
the bits into blocks and keeps one table for each choice of blocks that must
agree, with those blocks moved to the front as its key: two fingerprints
within ``radius`` bits agree on all but ``radius`` blocks at worst, so some
table has them under one key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.common import checkpointed, word_blocks

BITS = 128
MEMO = 200_000
_PAIR = np.uint64(0x9E3779B97F4A7C15)  # odd constants that spread bits, chosen once
_LANES = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _WordHashes(dict):
    """Word -> 64-bit hash, remembered up to ``MEMO`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _LANES[0]
    x = (x ^ (x >> np.uint64(29))) * _LANES[1]
    return x ^ (x >> np.uint64(32))


def term_counts(text: str | None, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes of a text and how often each occurs."""
    parts, last = [], None
    for words in word_blocks(text):
        ids = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        if len(ids):
            parts.append(ids)
            before = ids[:-1] if last is None else np.concatenate([[last], ids[:-1]]).astype(np.uint64)
            parts.append(_spread(before * _PAIR ^ (ids[1:] if last is None else ids)))
            last = ids[-1]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(np.concatenate(parts), return_counts=True)


def fingerprint(text: str | None, memo: dict) -> int:
    """Unsigned 128-bit fingerprint; 0 for a null text or one without words."""
    terms, counts = term_counts(text, memo)
    weights = np.round(16 * (1 + np.log(np.maximum(counts, 1))))
    votes = np.zeros(BITS)
    for i in range(0, len(terms), 1 << 15):  # float64 sums of whole numbers are exact
        part = terms[i:i + (1 << 15)]
        lanes = np.stack([_spread(part ^ lane) for lane in _LANES], axis=1)
        bits = np.unpackbits(lanes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
        votes += weights[i:i + (1 << 15)] @ (2.0 * bits - 1)
    return int.from_bytes(np.packbits(votes > 0, bitorder="little").tobytes(), "little") if len(terms) else 0


def likeness(a: int, b: int) -> float:
    """Share of equal bits."""
    return 1 - (a ^ b).bit_count() / BITS


def _ranges(docs: DataFrame, n_ranges: int) -> tuple[DataFrame, int]:
    """``docs`` with its descending doc_id range; the head of a range also closes the one before.

    Split points are approximate quantiles of doc_id, at most ``n_ranges``;
    they decide where rows are worked on, not what comes out. A null doc_id
    sorts last.
    """
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select("doc_id", "text", rank.alias("rank"))
    shares = [i / n_ranges for i in range(1, n_ranges)]
    found = rows.agg(F.percentile_approx("rank", F.array(*map(F.lit, shares)), 20_000)).first()[0] or []
    splits = np.unique(np.array(found, np.int64))

    @F.pandas_udf("int")
    def range_of(ranks: pd.Series) -> pd.Series:
        return pd.Series((len(splits) - np.searchsorted(splits, ranks.to_numpy(), "right")).astype(np.int32))

    heads = {r["range"]: r["head"] for r in rows.select("rank", range_of("rank").alias("range"))
             .groupBy("range").agg(F.max("rank").alias("head")).collect()}  # n_ranges rows at most
    order = sorted(heads)
    closes = [(heads[r], order[i - 1]) for i, r in enumerate(order)]  # the first head closes the last range
    lookup = docs.sparkSession.createDataFrame(closes, "rank long, closes int") if closes else None
    rows = rows.withColumn("range", range_of("rank"))
    if lookup is None:
        return rows.withColumn("context", F.lit(False)), 0
    context = (rows.join(F.broadcast(lookup), "rank")
               .select("doc_id", "text", "rank", F.col("closes").alias("range"), F.lit(True).alias("context")))
    return rows.select("doc_id", "text", "rank", "range", F.lit(False).alias("context")).union(context), len(order)


def with_next(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and its likeness to both neighbours.

    The next document follows in descending doc_id (null last; equal ids by
    text, null first); after the last comes the first, and a single document
    follows itself. The edited text has its last ``n_chars // 3`` code points
    replaced by the first as many (or all) of the next document. Null texts
    count as empty. Texts move once, to their doc_id range; only the head of
    each range is copied.
    """
    n_ranges = n_ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, _ = _ranges(docs, n_ranges)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, before, out = _WordHashes(), None, []
        for batch in batches:
            for doc_id, text, group, context in zip(*(batch.column(n).to_pylist() for n in
                                                      ("doc_id", "text", "range", "context"))):
                text = text or ""
                own = fingerprint(text, memo)
                if before is not None and before[2] == group and not before[3]:
                    edited = before[1][:len(before[1]) - len(before[1]) // 3] + text[:len(before[1]) // 3]
                    other = fingerprint(edited, memo)
                    out.append((before[0], len(before[1]), hashlib.sha256(edited.encode()).hexdigest(),
                                f"{before[4]:032x}", f"{other:032x}", likeness(before[4], other),
                                likeness(before[4], own)))
                before = (doc_id, text, group, context, own)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], names=names)
                out = []

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = list(to_arrow_schema(schema))
    dealt = rows.repartition("range").sortWithinPartitions("range", "context", F.desc("rank"), F.asc_nulls_first("text"))
    return dealt.select("doc_id", "text", "range", "context").mapInArrow(run, schema)


def block_tables(radius: int, blocks: int) -> list[int]:
    """A 128-bit mask for each choice of ``blocks - radius`` blocks that must agree."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    cut = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(cut[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def _halves(value: int) -> tuple[int, int]:
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(value >> 64), signed(value & ((1 << 64) - 1))


def _present(keys: DataFrame) -> tuple[DataFrame, int]:
    """A bit table (word, bits) of the ``key`` column and its size: 8 bits or more for each key, 2^16 to 2^26 in all."""
    size = 1 << min(26, max(16, (8 * keys.count()).bit_length()))
    word, bit = _place(size)
    placed = keys.select(F.expr(word).alias("word"), F.expr(f"shiftleft(1L, {bit})").alias("b"))
    return placed.groupBy("word").agg(F.bit_or("b").alias("bits")), size


def _place(size: int) -> tuple[str, str]:
    """Word and bit of ``key`` in a bit table."""
    return f"shiftright(key & {size - 1}L, 6)", "cast(key & 63 as int)"


def search(index: DataFrame, queries: DataFrame, radius: int = 4, blocks: int = 6) -> DataFrame:
    """(query, fingerprint, distance): all of ``index`` within ``radius`` bits of each query.

    Both frames have a ``fingerprint`` column of 32 hexadecimal digits, taken
    distinct. A table's key is hashed to 64 bits with the table's number; what
    meets is checked on all bits. Before the shuffle, a bit table of the
    queries' keys, of at most 2^20 rows, drops index rows that can meet none;
    where it is crowded it drops fewer and the result is the same. Null
    fingerprints match nothing.
    """
    masks = [_halves(m) for m in block_tables(radius, blocks)]
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(hi).alias("mh"), F.lit(lo).alias("ml"))
                       for t, (hi, lo) in enumerate(masks)])

    def keyed(df: DataFrame) -> DataFrame:
        value = df.filter("fingerprint is not null").select("fingerprint").distinct()
        half = lambda start: F.conv(F.substring("fingerprint", start, 16), 16, -10).cast("long")
        return (value.select(half(1).alias("hi"), half(17).alias("lo"), F.explode(tables).alias("m"))
                .select("hi", "lo", F.expr("xxhash64(m.t, hi & m.mh, lo & m.ml)").alias("key")))

    own = checkpointed(keyed(queries))
    present, size = _present(own)
    word, bit = _place(size)
    asked = (keyed(index).withColumn("word", F.expr(word)).join(F.broadcast(present), "word")
             .filter(F.expr(f"shiftrightunsigned(bits, {bit}) & 1 = 1")).select("hi", "lo", "key"))
    met = own.alias("q").join(asked.alias("i"), "key").select(
        "q.hi", "q.lo", F.col("i.hi").alias("ihi"), F.col("i.lo").alias("ilo"),
        F.expr("bit_count(q.hi ^ i.hi) + bit_count(q.lo ^ i.lo)").alias("distance"))
    text = lambda hi, lo: F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))
    return (met.filter(F.col("distance") <= radius).distinct()
            .select(text("hi", "lo").alias("query"), text("ihi", "ilo").alias("fingerprint"), "distance"))


def fingerprint_report(docs: DataFrame, every: int = 100, radius: int = 4, blocks: int = 6) -> DataFrame:
    """``with_next`` plus ``n_near`` for query documents (doc_id divisible by ``every``).

    ``n_near`` counts the other documents within ``radius`` bits, copies
    included, over all documents; it is null for documents that are no query.
    """
    rows = checkpointed(with_next(docs))
    sizes = rows.groupBy("fingerprint").agg(F.count("*").alias("n"))
    asked = rows.filter(F.col("doc_id") % every == 0).select("fingerprint").distinct()
    near = (search(sizes, asked, radius, blocks).join(sizes, "fingerprint")
            .groupBy(F.col("query").alias("fingerprint")).agg((F.sum("n") - 1).alias("found")))
    return (rows.join(near, "fingerprint", "left")
            .withColumn("n_near", F.when(F.col("doc_id") % every == 0, F.col("found"))).drop("found"))
