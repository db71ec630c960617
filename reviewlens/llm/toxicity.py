"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic models over words. The
model of a category also sees the probabilities of the earlier ones; while
training, those are out-of-fold, so it learns from probabilities as uncertain
as they will be on new texts.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.common import BLOCK_BYTES, map_texts

MAX_ROWS = 6_000
MIN_CONTEXTS = 5
MIN_Z = 6.0
FOLDS = 4
_WORD = re.compile(r"[^\W\d_]+")


def word_set(text: str | None) -> set[str]:
    """Distinct lower-cased letter runs of the whole text."""
    out, at, text = set(), 0, text or ""
    while at < len(text):
        end = at + BLOCK_BYTES
        while end < len(text) and not text[end].isspace():
            end += 1
        out.update(_WORD.findall(text[at:end].lower()))
        at = end
    return out


@dataclass
class Chain:
    """Per category a weight for each word of ``words``, then for each earlier category, then a bias."""

    categories: list[str]
    words: list[str]
    weights: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One column per category, for rows of 0/1 word indicators."""
        p = np.zeros((len(x), 0))
        for w in self.weights:
            p = np.column_stack([p, _sigmoid(np.column_stack([x, p, np.ones(len(x))]) @ w)])
        return p


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Newton's method; the last column is the bias and is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_chain(x: np.ndarray, labels: np.ndarray, groups: np.ndarray, categories: list[str], words: list[str]) -> Chain:
    """Fit the models in order; ``groups`` keeps equal texts in one fold."""
    earlier, weights = np.zeros((len(x), 0)), []
    fold = groups % FOLDS
    for k in range(len(categories)):
        whole = np.column_stack([x, earlier, np.ones(len(x))])
        y = labels[:, k].astype(float)
        weights.append(fit_logistic(whole, y))
        out = np.zeros(len(x))
        for f in range(FOLDS):
            rest = fold != f
            out[~rest] = _sigmoid(whole[~rest] @ fit_logistic(whole[rest], y[rest]))
        earlier = np.column_stack([earlier, out])
    return Chain(categories, words, weights)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = MAX_ROWS) -> Chain:
    """Fit on at most ``max_rows`` labelled documents, taken in the order of a hash of doc_id.

    ``labels`` has doc_id and a 0/1 column for each category, in chain order;
    rows with a null in any of them are not used, a doc_id given twice counts
    once. Words are features if they occur beside at least ``MIN_CONTEXTS``
    different pairs of neighbours in documents of a category, and more often
    there than elsewhere by ``MIN_Z`` standard errors; the many copies of one
    passage are one context, so copies alone make no feature.
    """
    known = (labels.select("doc_id", *categories).dropna().groupBy("doc_id")
             .agg(*[F.max(c).cast("int").alias(c) for c in categories])
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # No document has more distinct words than the sample, which is bounded in rows.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"]).cache()
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)]
                          + [T.StructField(c, T.IntegerType()) for c in categories]
                          + [T.StructField("word", T.StringType()), T.StructField("context", T.LongType())])

    def contexts(batches):
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                tokens = ["", *_WORD.findall((text or "").lower()), ""]
                seen = {(w, hash_pair(tokens[j], tokens[j + 2])) for j, w in enumerate(tokens[1:-1])}
                own = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own.column(c).to_numpy(zero_copy_only=False), len(seen)), own.column(c).type)
                     for c in ["doc_id", *categories]]
                    + [pa.array([w for w, _ in seen], pa.string()), pa.array([h for _, h in seen], pa.int64())],
                    names=schema.fieldNames())

    def hash_pair(a: str, b: str) -> int:
        return zlib.crc32(f"{a} {b}".encode())

    n = rows.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    met = rows.mapInArrow(contexts, schema)
    per_doc = met.groupBy("doc_id", "word", *categories).agg(F.lit(1).alias("one"))
    counts = per_doc.groupBy("word").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"n_{c}") for c in categories])
    places = met.groupBy("word", "context").agg(*[F.max(c).alias(c) for c in categories]).groupBy("word").agg(
        *[F.sum(c).alias(f"places_{c}") for c in categories])
    found = counts.join(places, "word")
    tests = F.lit(False)
    for c in categories:
        share = (n[c] or 0) / max(1, n["n"])
        expected = F.col("n") * share
        z = (F.col(f"n_{c}") - expected) / F.sqrt(expected * (1 - share) + 1e-9)
        tests = tests | ((F.col(f"places_{c}") >= MIN_CONTEXTS) & (z >= MIN_Z))
    words = sorted(r["word"] for r in found.filter(tests).select("word").collect())
    index = {w: i for i, w in enumerate(words)}

    def features(batches):
        for batch in batches:
            found = [sorted(index[w] for w in word_set(t) if w in index) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in categories] + [pa.array(found, pa.list_(pa.int32())), batch.column("group")],
                names=[*categories, "words", "group"])

    sample = (rows.withColumn("group", F.xxhash64(F.coalesce("text", F.lit(""))))
              .mapInArrow(features, ", ".join(f"{c} int" for c in categories) + ", words array<int>, group long")
              .orderBy("group", "words", *categories).collect())  # max_rows rows of a few numbers
    rows.unpersist()
    x = np.zeros((len(sample), len(words)), np.float32)
    for i, r in enumerate(sample):
        x[i, r["words"]] = 1
    y = np.array([[r[c] for c in categories] for r in sample]).reshape(len(sample), len(categories))
    return fit_chain(x, y, np.array([r["group"] for r in sample], np.int64), categories, words)


def predict(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` without text, with a probability ``p_<category>`` for each category, from whole texts.

    Null and empty texts have no words, so they get the models' base rates.
    """
    def start():
        index = {w: i for i, w in enumerate(chain.words)}

        def compute(texts):
            x = np.zeros((len(texts), len(index)))
            for i, text in enumerate(texts):
                x[i, [index[w] for w in word_set(text) & index.keys()]] = 1
            return [pa.array(column, pa.float64()) for column in chain.probabilities(x).T]
        return compute

    return map_texts(docs, [(f"p_{c}", T.DoubleType()) for c in chain.categories], start)
