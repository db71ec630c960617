"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage of the
whole text is encoded as shares and means over its words. Gated attention
(tanh and sigmoid branches) weighs the passages; the weighted representation
is scored by a logistic layer. All weights are learned from document labels
by full-batch Adam on a bounded sample of labelled documents.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.common import map_texts

PASSAGE = 50
HASHED = 12
WORD_STATS = 9
WIDTH = WORD_STATS + HASHED + 4
HIDDEN = 16
BLOCK_CHARS = 1 << 20
MAX_ROWS = 3_000
MAX_BAG = 32
MEMO = 200_000
THRESHOLD = 0.7


class _WordIndex(dict):
    """Word -> row of ``rows``, the words' feature vectors; cleared between batches when large.

    The first ``WORD_STATS`` columns are facts on the word's form, the others
    a hashed one-hot of its first and of its last three letters.
    """

    def __init__(self):
        super().__init__()
        self.rows = np.zeros((4096, WORD_STATS + HASHED), np.float32)
        self.new: list[tuple] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        low = word.lower().encode()
        head, last = word[:-1] or word, word[-1]
        plain = head.isalpha()
        core = plain or word.strip(".,;:!?'\"()-").isalnum()
        letters = plain or last.isalpha() or any(map(str.isalpha, word))
        digits = (not plain or last.isdigit()) and any(map(str.isdigit, word))
        n = len(word)
        self.new.append((n / 12 if n < 24 else 2, not letters, n > 1 and word.isupper(), word[0].isupper(), digits,
                         not core, last in ".,;:?", n <= 2, n > 14, zlib.crc32(low[:3]) % HASHED,
                         zlib.crc32(low[-3:]) % HASHED))
        return at

    def ids(self, words: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            added, self.new = np.array(self.new, np.float32), []
            end, start = len(self), len(self) - len(added)
            if end > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(end, len(self.rows)), self.rows.shape[1]), np.float32)])
            self.rows[start:end, :WORD_STATS] = added[:, :WORD_STATS]
            self.rows[start:end, WORD_STATS:] = 0
            for column in (WORD_STATS, WORD_STATS + 1):
                self.rows[np.arange(start, end), WORD_STATS + added[:, column].astype(np.int64)] += 0.5
        return found


def encode(text: str | None, index: _WordIndex) -> np.ndarray:
    """One row of ``WIDTH`` numbers for each passage; one zero row for a text without words."""
    out, text = [], text or ""
    at = 0
    while at < len(text):  # blocks end at a blank, so no long text is split into one list of words
        end = at + BLOCK_CHARS
        while end < len(text) and not text[end].isspace():
            end += 1
        block = text[at:end]
        words = block.split()
        if words:
            ids = index.ids(words)
            starts = np.arange(0, len(ids), PASSAGE)
            if len(starts) > 1 and len(ids) - starts[-1] < PASSAGE // 2:
                starts = starts[:-1]  # a short rest belongs to the passage before
            sizes = np.diff(np.append(starts, len(ids)))[:, None].astype(np.float32)
            means = np.add.reduceat(index.rows[ids], starts, axis=0) / sizes
            again = np.append([False], ids[1:] == ids[:-1]).astype(np.float32)
            owner = np.repeat(np.arange(len(starts)), sizes[:, 0].astype(np.int64))
            pairs = np.unique(owner * np.int64(1 << 32) + ids)
            distinct = np.bincount(pairs >> 32, minlength=len(starts)).astype(np.float32)
            lines = np.full(len(starts), block.count("\n") / len(words), np.float32)
            out.append(np.column_stack([means, np.add.reduceat(again, starts) / sizes[:, 0],
                                        distinct / sizes[:, 0], lines, np.minimum(sizes[:, 0] / PASSAGE, 1)]))
        at = end
    return np.concatenate(out).astype(np.float32) if out else np.zeros((1, WIDTH), np.float32)


@dataclass
class Model:
    """Gated attention weights; ``mean`` and ``scale`` standardise the passage encodings."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float

    def attend(self, passages: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Scores of the bags that begin at ``starts``, attention, and what the gradients need."""
        w = self.weights
        x = (passages - self.mean) / self.scale
        gate_t, gate_s = np.tanh(x @ w["V"]), 1 / (1 + np.exp(-(x @ w["U"])))
        energy = (gate_t * gate_s) @ w["a"]
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        e = np.exp(energy - np.maximum.reduceat(energy, starts)[owner])
        attention = e / np.add.reduceat(e, starts)[owner]
        bag = np.add.reduceat(attention[:, None] * x, starts, axis=0)
        score = 1 / (1 + np.exp(-np.clip(bag @ w["c"] + w["b"][0], -30, 30)))
        return score, attention, owner, x, gate_t, gate_s, bag

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
        return self.attend(np.concatenate(bags), starts)[0] if bags else np.zeros(0)


def fit(bags: list[np.ndarray], labels: list[int], steps: int = 150, rate: float = 0.05, decay: float = 1e-4,
        seed: int = 7) -> Model:
    """Learn from bags of passage encodings and their document labels.

    Without labels every score is 0.5; with one class every score is close to it.
    """
    y = np.array(labels, np.float32)
    prior = float((y.sum() + 1) / (len(y) + 2))
    random = np.random.default_rng(seed)
    weights = {"V": random.normal(0, 0.3, (WIDTH, HIDDEN)), "U": random.normal(0, 0.3, (WIDTH, HIDDEN)),
               "a": random.normal(0, 0.3, HIDDEN), "c": np.zeros(WIDTH), "b": np.array([np.log(prior / (1 - prior))])}
    if not bags:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), weights, prior)
    passages = np.concatenate(bags)
    starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
    model = Model(passages.mean(0), np.maximum(passages.std(0), 0.02),
                  {k: v.astype(np.float32) for k, v in weights.items()}, prior)
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    for step in range(1, steps + 1):
        w = model.weights
        p, attention, owner, x, t, s, bag = model.attend(passages, starts)
        err = (p - y) / len(y)
        into = err[owner] * (x @ w["c"])  # d loss / d attention
        energy = attention * (into - np.add.reduceat(attention * into, starts)[owner])
        both = energy[:, None] * w["a"]
        grads = {"c": bag.T @ err, "b": np.array([err.sum()]), "a": (t * s).T @ energy,
                 "V": x.T @ (both * s * (1 - t * t)), "U": x.T @ (both * t * s * (1 - s))}
        for k, g in grads.items():
            g = g + (decay * w[k] if k != "b" else 0)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w[k] = w[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled documents, taken in the order of a hash of doc_id.

    A sampled document of more than ``MAX_BAG`` passages is represented by that
    many, evenly spaced, while training; scoring always reads all passages.
    Rows whose label or doc_id is null are not used; a label given twice counts
    once (its smallest value).
    """
    known = (labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.min(label_col).alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    schema = "doc_id long, label int, bag binary"

    def bags(batches):
        index = _WordIndex()
        for batch in batches:
            found = [encode(t, index) for t in batch.column("text").to_pylist()]
            found = [b if len(b) <= MAX_BAG else b[np.linspace(0, len(b) - 1, MAX_BAG).astype(int)] for b in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()),
                 pa.array([b.tobytes() for b in found], pa.binary())], names=["doc_id", "label", "bag"])

    rows = (docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").mapInArrow(bags, schema)
            .orderBy("doc_id", "bag").collect())  # max_rows documents, MAX_BAG passages each, at most
    return fit([np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH) for r in rows], [r["label"] for r in rows])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep_text: bool = False) -> DataFrame:
    """``docs`` without text (or with it), with ``score`` (0 to 1) and ``predicted``, from whole texts.

    A null text is scored like an empty one.
    """
    def start():
        index = _WordIndex()

        def compute(texts):
            out = []
            for i in range(0, len(texts), 512):
                out.append(model.score([encode(t, index) for t in texts[i:i + 512]]))
                if len(index) > MEMO:
                    index.clear()
            p = np.concatenate(out) if out else np.zeros(0)
            return [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())]
        return compute

    return map_texts(docs, [("score", T.DoubleType()), ("predicted", T.IntegerType())], start, keep_text=keep_text)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their columns unchanged."""
    names = docs.columns
    safe = docs.select(*[F.col(f"`{c}`").alias(c if c == "text" else f"kept_{i}") for i, c in enumerate(names)])
    good = score(safe, model, threshold, keep_text=True).filter("predicted = 1")
    return good.select(*[F.col(c if c == "text" else f"kept_{i}").alias(c) for i, c in enumerate(names)])
