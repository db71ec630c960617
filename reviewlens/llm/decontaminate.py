"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased. N-grams of the benchmark
items seed candidate passages of the training texts; a passage and an item are
then aligned word by word, so edited and paraphrased copies score too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import BLOCK_BYTES, checkpointed, row_key, small_side

SEED_WORDS = 3
FILTER_BITS = 24
SEGMENT_WORDS = 256
MATCH, MISMATCH, GAP = 2, -1, 1
MIN_SCORE = 0.5
MIN_MATCHED = 8
MEMO = 200_000
RARE = 16
_WORD = re.compile(r"[^\W_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)  # an odd constant that spreads bits


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode())
        return value


def _blocks(text: str) -> Iterator[list[str]]:
    """Words of a text, about a megabyte at a time; blocks end at white space."""
    at = 0
    while at < len(text):
        end = at + BLOCK_BYTES
        while end < len(text) and not text[end].isspace():
            end += 1
        yield _WORD.findall(text[at:end].lower())
        at = end


def _grams(ids: np.ndarray) -> np.ndarray:
    keys = np.zeros(max(0, len(ids) - SEED_WORDS + 1), np.uint64)
    for j in range(SEED_WORDS):
        keys = (keys ^ ids[j:j + len(keys)]) * _STEP
        keys ^= keys >> np.uint64(32)
    return keys


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, segment, words, seeds) of the items with at least ``SEED_WORDS`` words.

    Items of more than one and a half ``SEGMENT_WORDS`` are cut into segments
    that are aligned by themselves, so an alignment's size is bounded.
    """
    schema = "item_id long, segment int, words array<string>, seeds array<struct<seed: long, at: int>>"

    def run(batches):
        memo = _WordHashes()
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                all_words = [w for block in _blocks(text or "") for w in block]
                cuts = list(range(0, max(1, len(all_words) - SEGMENT_WORDS // 2), SEGMENT_WORDS))
                for k, (low, high) in enumerate(zip(cuts, cuts[1:] + [len(all_words)])):
                    part = all_words[low:high]
                    keys = _grams(np.array([memo[w] for w in part], np.uint64)).view(np.int64).tolist()
                    if keys:
                        out.append({"item_id": item, "segment": k, "words": part,
                                    "seeds": [{"seed": s, "at": i} for i, s in enumerate(keys)]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([("item_id", pa.int64()), ("segment", pa.int32()), ("words", pa.list_(pa.string())),
                       ("seeds", pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())])))])
    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(run, schema)


def seed_filter(items: DataFrame) -> bytes:
    """A bitmap over 2^``FILTER_BITS`` hash slots of all seeds: its size is fixed, however many there are."""
    slot = F.shiftrightunsigned(F.col("s.seed"), 64 - FILTER_BITS).cast("int").alias("slot")
    slots = items.select(F.explode("seeds").alias("s")).select(slot).distinct().toArrow()  # one row per bit at most
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[slots.column("slot").to_numpy()] = True
    return np.packbits(bits).tobytes()


def passages(docs: DataFrame, items: DataFrame, reach: int) -> DataFrame:
    """(doc_id, passage, words, seeds): stretches of whole texts around n-grams that may be seeds.

    Every n-gram is looked up in the seed bitmap. Hits at most ``2 reach``
    words apart share a passage, which extends ``reach`` words to both sides;
    where hits follow each other for longer, the next passage begins after
    ``2 reach`` words, so none is longer than ``4 reach`` and a seed, and every
    hit has its reach on both sides in one of them. ``seeds`` are the hits
    within the passage, ``passage`` is a hash of the words. Nothing else of a
    text leaves the scan.
    """
    sent = docs.sparkSession.sparkContext.broadcast(seed_filter(items))
    arrow = pa.schema([("passage", pa.int64()), ("words", pa.string()), ("seeds", pa.list_(pa.int64()))])

    def hits_in(text: str, known: np.ndarray, memo: dict) -> tuple[np.ndarray, np.ndarray]:
        places, seeds, base, tail = [], [], 0, np.zeros(0, np.uint64)
        for block in _blocks(text):
            ids = np.concatenate([tail, np.fromiter(map(memo.__getitem__, block), np.uint64, len(block))])
            keys = _grams(ids)
            slot = _slot(keys)
            found = np.flatnonzero(known[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
            places.append(found + base)
            seeds.append(keys[found].view(np.int64))
            tail = ids[max(0, len(ids) - SEED_WORDS + 1):]
            base += len(ids) - len(tail)
        return (np.concatenate(places), np.concatenate(seeds)) if places else (np.zeros(0, np.int64),) * 2

    def passages_in(text: str, known: np.ndarray, memo: dict) -> Iterator[dict]:
        at, seeds = hits_in(text, known, memo)
        if not len(at):
            return
        groups = np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * reach) + 1)
        groups = [g for whole in groups for g in np.split(whole, np.flatnonzero(np.diff((at[whole] - at[whole[0]]) // (2 * reach))) + 1)]
        low = [max(0, int(at[g[0]]) - reach) for g in groups]
        high = [int(at[g[-1]]) + SEED_WORDS + reach for g in groups]
        within = [(np.searchsorted(at, low[k]), np.searchsorted(at, high[k] - SEED_WORDS, "right")) for k in range(len(groups))]
        kept, base, first = [[] for _ in groups], 0, 0
        for block in _blocks(text):
            while first < len(groups) and high[first] <= base:
                first += 1
            k = first
            while k < len(groups) and low[k] < base + len(block):
                kept[k] += block[max(0, low[k] - base):high[k] - base]
                k += 1
            base += len(block)
        for k, (start, end) in enumerate(within):
            joined = " ".join(kept[k])
            yield {"passage": xxhash.xxh64_intdigest(joined.encode()) - (1 << 63), "words": joined,
                   "seeds": np.unique(seeds[start:end]).tolist()}

    def run(batches):
        known, memo = np.frombuffer(sent.value, np.uint8), _WordHashes()
        for batch in batches:
            ids, owner, out = batch.column("doc_id"), [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for found in passages_in(text or "", known, memo):
                    owner.append(row)
                    out.append(found)
            body = pa.RecordBatch.from_pylist(out, schema=arrow)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner, pa.int64())), *body.columns],
                                             names=["doc_id", *arrow.names])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, passage long, words string, seeds array<long>")


def align(item: list[str], text: list[str]) -> tuple[int, int, int, int]:
    """Best local alignment: its score, matched words, and the stretch of ``text`` it covers."""
    number = {}
    a = np.array([number.setdefault(w, len(number)) for w in item], np.int32)
    b = np.array([number.setdefault(w, len(number)) for w in text], np.int32)
    steps = np.arange(len(b) + 1, dtype=np.int32) * GAP
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, word in enumerate(a):
        row = np.zeros(len(b) + 1, np.int32)
        np.maximum(table[i, :-1] + np.where(b == word, MATCH, MISMATCH), table[i, 1:] - GAP, out=row[1:])
        np.maximum(row, 0, out=row)
        table[i + 1] = np.maximum.accumulate(row + steps) - steps  # gaps along the text, in one sweep
    i, j = map(int, np.unravel_index(table.argmax(), table.shape))
    score, matched, end = int(table[i, j]), 0, j
    while i and j and table[i, j] > 0:
        same = a[i - 1] == b[j - 1]
        if table[i, j] == table[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matched += bool(same)
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] - GAP:
            i -= 1
        else:
            j -= 1
    return score, matched, j, end


def _aligned(pairs: DataFrame, min_score: float) -> DataFrame:
    """Score (passage, words, item_id, segment, item): share of the best possible score, matched words.

    A pair is left out if too few of the item's words are in the passage, in
    whatever order, to reach ``min_score`` or ``MIN_MATCHED``.
    """
    arrow = pa.schema([("passage", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                       ("matched", pa.int32()), ("item_words", pa.int32())])

    def run(batches):
        for batch in batches:
            out = []
            for passage, words, item_id, item in zip(*(batch.column(c).to_pylist() for c in range(4))):
                words = words.split(" ")
                most = sum(map(set(words).__contains__, item))  # no alignment matches more words
                if most < max(min_score * len(item), min(MIN_MATCHED, len(item))):
                    continue
                score, matched, _, _ = align(item, words)
                out.append({"passage": passage, "item_id": item_id, "matched": matched,
                            "score": score / (MATCH * len(item)), "item_words": len(item)})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return pairs.select("passage", "words", "item_id", "item").mapInArrow(
        run, "passage long, item_id long, score double, matched int, item_words int")


def needed(words: Column, min_score: float) -> Column:
    """How many of an item's words a passage must hold to be aligned."""
    return F.ceil(F.greatest(F.lit(min_score) * F.size(words), F.least(F.lit(MIN_MATCHED), F.size(words))))


def _prefixes(items: DataFrame, seeds: DataFrame, min_score: float) -> DataFrame:
    """(item_id, segment, seed, word) of items with frequent ``seeds``: the rarest words, one of which a passage must hold.

    Of an item's n words a passage must hold m, so it holds one of any
    n - m + 1 of them. Words are ranked by the number of items that hold them.
    """
    hot = items.join(seeds.select("item_id", "segment").distinct(), ["item_id", "segment"])
    placed = hot.select("item_id", "segment", needed(F.col("words"), min_score).alias("m"), F.size("words").alias("n"),
                        F.explode("words").alias("word"))
    spread = items.select("item_id", F.explode("words").alias("word")).distinct().groupBy("word").agg(F.count("*").alias("items"))
    ranked = placed.join(spread, "word").groupBy("item_id", "segment").agg(  # an item's words, of bounded number
        F.max("m").alias("m"), F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("items", "word"))).alias("words"))
    first = ranked.select("item_id", "segment", F.explode(F.array_distinct(F.slice(
        "words", F.lit(1), (F.col("n") - F.col("m") + 1).cast("int")))["word"]).alias("word"))
    return seeds.join(first, ["item_id", "segment"])


def candidates(texts: DataFrame, items: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(passage, item_id, segment): pairs that share an n-gram and may share enough words; no texts are carried.

    An n-gram is rare if at most ``RARE`` distinct passages, or at most
    ``RARE`` items, hold it: it gives at most ``RARE`` pairs for each of its
    rows on the other side, and pairs them at once. A frequent n-gram pairs a
    passage with an item only if they also share one of the item's rarest
    words, as many of them as no pair with enough common words can avoid. So
    passages and items that share nothing but a common phrase never meet, and
    no pair is lost.
    """
    seeds = checkpointed(items.select("item_id", "segment", F.explode("seeds").alias("s")).select(
        "item_id", "segment", "s.seed").distinct())
    hits = texts.select("passage", F.explode("seeds").alias("seed"))
    held = hits.groupBy("seed").agg(F.count("*").alias("passages"))
    wanted = seeds.groupBy("seed").agg(F.count("*").alias("items"))
    both = checkpointed(held.join(wanted, "seed").withColumn("rare", (F.col("passages") <= RARE) | (F.col("items") <= RARE)))
    rare, frequent = both.filter("rare").select("seed"), both.filter("not rare").select("seed")
    by_seed = hits.join(seeds.join(rare, "seed"), "seed").select("passage", "item_id", "segment")
    keys = checkpointed(_prefixes(items, seeds.join(frequent, "seed"), min_score))
    if keys.isEmpty():
        return by_seed.distinct()
    # A passage's frequent seeds and its words that are in some prefix meet in their own row first.
    words = keys.select("word").distinct()
    crowded = texts.select("passage", "words", F.explode("seeds").alias("seed")).join(
        small_side(checkpointed(frequent)), "seed").groupBy("passage").agg(
        F.first("words").alias("words"), F.collect_list("seed").alias("seeds"))
    held_words = crowded.select("passage", "seeds", F.explode(F.array_distinct(F.split("words", " "))).alias("word")).join(
        small_side(checkpointed(words)), "word", "left_semi")
    by_word = held_words.select("passage", "word", F.explode("seeds").alias("seed")).join(keys, ["seed", "word"]).select(
        "passage", "item_id", "segment")
    return by_seed.unionByName(by_word).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, item_id, score, matched): documents that hold a copy, edited or not, of an item.

    A passage is aligned with every item it shares an n-gram with, unless too
    few of the item's words are in it; ``candidates`` finds these pairs by rare
    n-grams first. ``score`` is the alignment's share of the item's full score, the
    best over its segments and passages; pairs count from ``min_score`` and
    from ``MIN_MATCHED`` matched words, or all of a shorter item. Each distinct
    passage is aligned once, whoever holds it. Null and empty texts, and items
    of fewer than ``SEED_WORDS`` words, match nothing; repeated rows give one
    row. Rows without doc_id are one document. Very long texts become many
    passages of bounded length.
    """
    items = checkpointed(items_of(benchmark))
    longest = items.agg(F.max(F.size("words"))).first()[0] or 0
    found = checkpointed(passages(docs, items, max(1, longest + longest // 4)))
    texts = found.groupBy("passage").agg(F.first("words").alias("words"), F.first("seeds").alias("seeds"))
    pairs = (candidates(texts, items, min_score).join(texts.select("passage", "words"), "passage")
             .join(items.select("item_id", "segment", F.col("words").alias("item")), ["item_id", "segment"]))
    good = _aligned(pairs, min_score).filter((F.col("score") >= min_score)
                                  & (F.col("matched") >= F.least(F.lit(MIN_MATCHED), F.col("item_words"))))
    owners = found.select("doc_id", "passage").distinct()
    return (owners.join(good, "passage").groupBy("doc_id", "item_id")
            .agg(F.max("score").alias("score"), F.max("matched").alias("matched")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; rows that share a doc_id, or have none, are judged one by one."""
    own = row_key(docs)
    keys = checkpointed(contaminated(docs.select(own.alias("doc_id"), "text"), benchmark, min_score).select(
        F.col("doc_id").alias("key")).distinct())
    return docs.join(small_side(keys), own == keys["key"], "left_anti")
