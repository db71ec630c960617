"""Language identification with a character-trigram naive Bayes model.

Training and scoring are Spark aggregations and joins over whole texts:

* training: every trigram of ``lower(text)`` is counted per language; the
  model keeps every trigram with weight ``ln(count + 1)``, plus one
  normaliser row per language with ``ln(N_lang + V)`` (add-one smoothing,
  ``V`` = distinct trigrams seen in training);
* scoring: the trigrams of each text are matched against one model row per
  trigram and summed per text;
  score = sum of matched weights - n_trigrams * ln(N_lang + V);
* prediction: highest score, ties by language code; a text with no trigram
  is undetectable (null).

Trigrams are counted in vectors inside the map tasks, so no row is made for a
single trigram. The model goes to every task up to a byte budget, its heaviest
trigrams first; occurrences of the others meet their weights in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from reviewlens.plans.joins import DEFAULT_BROADCAST_BYTES

NORMALISER = -1  # no trigram key is negative, so -1 marks the per-language row
BLOCK = 1 << 20  # characters of a text that are looked at together
PENDING = 1 << 21  # trigrams that a task holds before it counts them


def trigrams(text: str | None) -> Iterator[np.ndarray]:
    """All overlapping trigrams of ``text`` as exact long keys, block by block.

    A trigram of code points (a, b, c) is ``a<<42 | b<<21 | c`` (code points
    fit in 21 bits), so counting and matching run on longs.
    """
    for at in range(0, max(len(text or "") - 2, 0), BLOCK):
        c = np.frombuffer(text[at:at + BLOCK + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        yield c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def train_profile(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, weight) rows: every trigram of each language + one normaliser row per language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = {}, 0

        def counted():
            for lang, parts in pending.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(grams), np.int64))),
                                                  pa.array(grams), pa.array(n.astype(np.int64))], names=["lang", "gram", "c"])

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                for grams in trigrams(text):
                    pending.setdefault(lang, []).append(grams)
                    size += len(grams)
                    if size >= PENDING:
                        yield from counted()
                        pending, size = {}, 0
        yield from counted()

    texts = labelled.filter(F.col(lang_col).isNotNull()).select(F.lower(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = texts.mapInArrow(run, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    vocab = counts.agg(F.count_distinct("gram").alias("v"))
    totals = counts.groupBy("lang").agg(F.sum("c").alias("n"))
    weights = counts.select("lang", "gram", F.log(F.col("c") + 1).alias("weight"))
    norm = totals.select("lang", F.lit(NORMALISER).cast("long").alias("gram"),
                         F.log(F.col("n") + vocab.scalar()).alias("weight"))
    return weights.unionByName(norm)


def _weights_sent(wide: DataFrame, n_langs: int, max_bytes: int) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """Trigrams, ascending, and their weights for every task, ``max_bytes`` at most; the rows left to a join, if any."""
    most = max(1, max_bytes // (8 + 8 * n_langs))
    sums = [f"__w{i}" for i in range(n_langs)]
    sent, rest = wide, None
    if wide.count() > most:
        heaviest = F.greatest(*sums, F.lit(0.0))
        bound = wide.select(heaviest.alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("w"))
        # Weights are logarithms of counts, so there are few different heavy ones: as many as fit are taken whole.
        held, least = 0, float("inf")
        for row in bound.limit(most).toLocalIterator():
            held += row["n"]
            if held > most:
                break
            least = row["w"]
        sent, rest = wide.filter(heaviest >= F.lit(least)), wide.filter(heaviest < F.lit(least))
    table = sent.toArrow().sort_by("gram")
    weights = [table.column(c).fill_null(0.0).to_numpy() for c in sums]
    return table.column("gram").to_numpy(), np.stack(weights, axis=1) if weights else np.zeros((0, 0)), rest


def _found(known: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each of ``grams`` in the ascending ``known``, and whether it is there."""
    if not len(known):
        return np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    return at, known[at] == grams


def detect(df: DataFrame, profile: DataFrame, key: tuple[str, ...] = ("product", "seq"), text_col: str = "text",
           out: str = "lang_pred", max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """``df`` without its text, with ``out`` = most likely language of ``text_col`` (null when undetectable).

    One pass over the texts: a task counts each text's trigrams and adds up the
    weights that were sent to it (``max_bytes`` at most). Only if the model is
    larger, a second pass deals out the trigrams that were not sent. ``key``
    identifies a text; the other columns of ``df`` travel with it.
    """
    kept = [c for c in df.columns if c != text_col]
    key = [c for c in key if c in kept]
    others = [c for c in kept if c not in key]
    long = profile.persist(StorageLevel.MEMORY_AND_DISK)
    norms = {r["lang"]: r["weight"] for r in long.filter(F.col("gram") == NORMALISER).collect()}  # one per language
    langs = sorted(norms)
    if not langs:
        long.unpersist()
        return df.select(*kept, F.lit(None).cast("string").alias(out))
    wide = long.filter(F.col("gram") != NORMALISER).groupBy("gram").agg(*[
        F.sum(F.when(F.col("lang") == lang, F.col("weight"))).alias(f"__w{i}") for i, lang in enumerate(langs)])
    wide = wide.persist(StorageLevel.MEMORY_AND_DISK)
    known, weights, rest = _weights_sent(wide, len(langs), max_bytes)
    long.unpersist()
    sent = df.sparkSession.sparkContext.broadcast((known, weights))
    sums = [f"__s{i}" for i in range(len(langs))]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = sent.value
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, len(sums)))
            for i, text in enumerate(batch.column("__text").to_pylist()):
                for block in trigrams(text):
                    n[i] += len(block)
                    grams, times = np.unique(block, return_counts=True)
                    at, there = _found(known, grams)
                    total[i] += times[there] @ weights[at[there]]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(n), *map(pa.array, total.T.copy())],
                                             names=[*kept, "__n", *sums])

    def unsent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = sent.value
        for batch in batches:
            rows, keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, text in enumerate(batch.column("__text").to_pylist()):
                for block in trigrams(text):
                    grams, n = np.unique(block, return_counts=True)
                    new = ~_found(known, grams)[1]
                    rows.append(np.full(new.sum(), i)), keys.append(grams[new]), times.append(n[new].astype(np.int64))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in key], *map(pa.array, map(np.concatenate, (keys, times)))],
                                             names=[*key, "gram", "times"])

    docs = df.select(*kept, F.lower(text_col).alias("__text"))
    schema = StructType(df.select(*kept).schema.fields).add("__n", LongType())
    for c in sums:
        schema = schema.add(c, DoubleType())
    texts = docs.mapInArrow(scored, schema).select(*key, "__n", F.struct(F.lit(1).alias("__own"), *others).alias("__others"), *sums)
    if rest is not None:
        schema = StructType(df.select(*key).schema.fields).add("gram", LongType()).add("times", LongType())
        met = docs.select(*key, "__text").mapInArrow(unsent, schema).join(rest, "gram").groupBy(*key).agg(*[
            F.coalesce(F.sum(F.col("times") * F.col(f"__w{i}")), F.lit(0.0)).alias(c) for i, c in enumerate(sums)])
        texts = texts.unionByName(met, allowMissingColumns=True)
    texts = texts.groupBy(*key).agg(F.max("__n").alias("__n"), F.first("__others", ignorenulls=True).alias("__others"),
                                    *[F.sum(c).alias(c) for c in sums]).select(*key, "__n", "__others.*", *sums)
    score = [F.col(c) - F.col("__n") * F.lit(norms[lang]) for c, lang in zip(sums, langs)]
    best = F.array_max(F.array(*score))
    first = F.coalesce(*[F.when(s == best, F.lit(lang)) for s, lang in zip(score, langs)])  # ties: by language code
    return texts.select(*kept, F.when(F.col("__n") > 0, first).alias(out))
