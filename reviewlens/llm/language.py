"""Language identification with language-bitmask n-gram filters.

Learning finds, for each language, the character n-grams typical of it. All of
them go into one bit-sliced Bloom filter: a slot holds one bit for each
language, so the AND over an n-gram's slots returns every language that
contains it. Prediction counts the hits of each language over all n-grams of
a text, subtracts those its filter's false-positive rate explains, and takes
the language with the most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.common import map_texts

SIZES = (2, 3)
SLOT_BITS = 22
HASHES = 2
MIN_SHARE = 1e-6
TYPICAL = 0.4
FLUSH = 1 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # odd constants that spread bits


def _letter_table() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return table


def gram_keys(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram keys of lower-cased letter runs with blanks at both ends, their text's index, letters per text.

    A key packs up to three code points and is exact.
    """
    lower = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lower])
    is_letter = letters[points]
    n_letters = np.bincount(owner[is_letter], minlength=len(texts))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]   # the blank behind a word
    keep[:-1] |= is_letter[1:]   # the blank before it
    points, owner, is_letter = np.where(is_letter, points, 32)[keep].astype(np.uint64), owner[keep], is_letter[keep]
    keys, owners = [], []
    for n in SIZES:
        m = len(points) - n + 1
        if m <= 0:
            continue
        key, fits = np.full(m, n, np.uint64), np.ones(m, bool)
        for j in range(n):
            key = key << np.uint64(21) | points[j:j + m]
            if 0 < j < n - 1:
                fits &= is_letter[j:j + m]
        fits &= (owner[:m] == owner[n - 1:]) & (is_letter[:m] | is_letter[n - 1:]) if n == 2 else owner[:m] == owner[n - 1:]
        keys.append(key[fits])
        owners.append(owner[:m][fits])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n_letters
    return np.concatenate(keys), np.concatenate(owners), n_letters


def slots(keys: np.ndarray) -> list[np.ndarray]:
    """The ``HASHES`` slots of each key."""
    out = []
    for mix in _MIX[:HASHES]:
        x = (keys ^ (keys >> np.uint64(33))) * mix
        x = (x ^ (x >> np.uint64(29))) * _MIX[0]
        out.append((x >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
    return out


@dataclass
class Model:
    """``filter``: a language bitmask per slot; languages in order of training share."""

    languages: list[str]
    filter: np.ndarray
    false_positive: np.ndarray

    def predict(self, texts: list[str | None], letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        texts = [t or "" for t in texts]
        keys, owner, n_letters = gram_keys(texts, letters)
        found = np.full(len(keys), ~np.uint64(0) >> np.uint64(64 - len(self.languages)) if self.languages else 0, np.uint64)
        for at in slots(keys):
            found &= self.filter[at]
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        hits = np.zeros((len(texts), max(1, len(self.languages))))
        for i, fp in enumerate(self.false_positive):
            seen = np.bincount(owner[(found >> np.uint64(i) & np.uint64(1)).astype(bool)], minlength=len(texts))
            hits[:, i] = np.maximum(0, (seen - total * fp) / (1 - fp)) if fp < 1 else 0
        best = hits.argmax(axis=1)  # the larger language if equal
        share = hits.max(axis=1) / np.maximum(hits.sum(axis=1), 1e-12)
        named = [self.languages[b] if n and self.languages else "und" for b, n in zip(best, n_letters)]
        return named, np.where(n_letters > 0, np.minimum(share, 1), 0.0)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows; each task sums its own n-grams before the shuffle."""
    def count(batches):
        letters, parts, size = _letter_table(), {}, 0

        def flush():
            for lang, found in parts.items():
                keys = np.concatenate([k for k, _ in found])
                grams, where = np.unique(keys, return_inverse=True)
                n = np.bincount(where, np.concatenate([c for _, c in found]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()),
                                                  pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))],
                                                 names=["lang", "gram", "n"])

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            for lang in dict.fromkeys(langs):
                own = [t for t, other in zip(texts, langs) if other == lang]
                at = 0
                while at < len(own):  # about a million characters at a time
                    end, chars = at, 0
                    while end < len(own) and chars < FLUSH:
                        chars += len(own[end])
                        end += 1
                    grams, n = np.unique(gram_keys(own[at:end], letters)[0], return_counts=True)
                    parts.setdefault(lang, []).append((grams, n))
                    size += len(grams)
                    at = end
            if size > 4 * FLUSH:
                yield from flush()
                parts, size = {}, 0
        yield from flush()

    rows = docs.filter("text is not null and lang is not null").select("text", "lang")
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> Model:
    """Learn from every row of ``docs`` (text, lang); null texts and languages are left out.

    An n-gram belongs to a language if it makes up at least ``MIN_SHARE`` of
    the language's n-grams (so at most 1 / ``MIN_SHARE`` of each size do) and
    at least ``TYPICAL`` of its largest share in any language. At most 64
    languages fit in a slot.
    """
    counts = gram_counts(docs)
    totals = [(r["lang"], r["n"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()]
    languages = [lang for lang, _ in sorted(totals, key=lambda x: (-x[1], x[0]))]
    if len(languages) > 64:
        raise ValueError("a slot holds 64 languages; use several models")
    empty = np.zeros(1 << SLOT_BITS, np.uint64)
    if not languages:
        return Model([], empty, np.zeros(0))
    size_of = F.create_map(*[F.lit(x) for pair in totals for x in pair])
    bit_of = F.create_map(*[x for i, lang in enumerate(languages) for x in
                            (F.lit(lang), F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long"))])
    shares = counts.select("gram", "lang", (F.col("n") / size_of[F.col("lang")]).alias("share")).filter(
        F.col("share") >= MIN_SHARE)
    per_gram = shares.groupBy("gram").agg(F.collect_list(F.struct("lang", "share")).alias("in"),  # 64 languages at most
                                          F.max("share").alias("top"))
    typical = per_gram.select("gram", F.explode("in").alias("in"), "top").filter(
        F.col("in.share") >= TYPICAL * F.col("top"))
    masks = typical.groupBy("gram").agg(F.bit_or(bit_of[F.col("in.lang")]).alias("mask"))
    found = masks.select("gram", "mask").toArrow()  # 64 / MIN_SHARE rows of each size at most
    keys, mask = (found.column(c).to_numpy().view(np.uint64) for c in ("gram", "mask"))
    for at in slots(keys) if len(keys) else []:
        np.bitwise_or.at(empty, at, mask)
    fill = np.array([np.count_nonzero(empty >> np.uint64(i) & np.uint64(1)) for i in range(len(languages))])
    return Model(languages, empty, (fill / len(empty)) ** HASHES)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without text, with ``lang_pred`` and ``score``, from whole texts.

    ``und`` with score 0 for a text that is null or has no letter. A text with
    letters but no known n-gram gets the language most trained on, score 0.
    """
    narrow = model.filter.astype(np.uint8) if len(model.languages) <= 8 else model.filter
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, narrow, model.false_positive))

    def start():
        languages, packed, fp = sent.value
        mine, letters = Model(languages, packed.astype(np.uint64), fp), _letter_table()

        def compute(texts):
            names, shares, at = [], [], 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and chars < FLUSH:
                    chars += len(texts[end] or "")
                    end += 1
                named, share = mine.predict(texts[at:end], letters)
                names += named
                shares.append(share)
                at = end
            return [pa.array(names, pa.string()), pa.array(np.concatenate(shares) if shares else [], pa.float64())]
        return compute

    return map_texts(docs, [("lang_pred", T.StringType()), ("score", T.DoubleType())], start)
