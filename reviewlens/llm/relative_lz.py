"""Substring dedup by relative Lempel-Ziv parsing.

Passages are factored greedily against indexed reference blocks; a factor of at
least ``window`` words is a duplicate span, and windows that lie across a
factor's border are looked up on their own.

No document meets every block. Each window of ``window`` words has an anchor,
the least k-gram hash in it, and equal windows have equal anchors at equal
places. Consecutive windows with one anchor make up a phrase. A phrase's
partners share its anchor, so the one reference block that holds the phrases
of that anchor is the only one that can match it. Phrases whose anchor comes
nowhere else are done; equal phrases are one row with a count, so a group of
copies costs one. What is left, phrases that share an anchor but not all of
their words, is parsed.

A block indexes its phrases by a suffix array. The longest match of a place is
the longer of the common prefixes with its two neighbours there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reviewlens.llm.common import ROWS, word_bounds, word_lists, written

MEMO = 200_000
BLOCK_WORDS = 1 << 19  # words of a reference block, give or take an anchor's
CROWD = 2_000  # phrases of one anchor that a block takes; more of them meet by the hash of each window
STRETCH = 1 << 18  # windows of a text that are cut into phrases at once
_COUNT_BITS, _START_BITS = 6, 32
_CHECK_BITS = 63 - _COUNT_BITS - _START_BITS
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # odd constants that spread bits, chosen once


class _WordHashes(dict):
    """Word -> 64-bit hash, remembered up to ``MEMO`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[0]
    return x ^ (x >> np.uint64(29))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of two grams as one; not linear, so no text has systematic collisions."""
    return _mixed(_mixed(left) * _ODD[1] + right)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on, by doubling."""
    have, out = 1, words
    while 2 * have <= size:
        out, have = _joined(out[:-have], out[have:]), 2 * have
    return out if have == size else _joined(out[:len(words) - size + 1], out[size - have:])


def sliding_argmin(values: np.ndarray, span: int) -> np.ndarray:
    """Place of the first least value among the ``span`` values from each place on."""
    at, have = np.arange(len(values)), 1
    while have < span:
        step = min(have, span - have)
        right = values[step:] < values[:-step]
        values, at = np.where(right, values[step:], values[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return at


def seed_length(window: int) -> int:
    """Words of an anchor: a sixth of the window, but so that no phrase has more windows than a mask has bits."""
    return max(window // 6, window + 3 - (1 << _COUNT_BITS), 1)


def phrases_of(words: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, phrase, start, count) of the phrases of a text given by its word hashes.

    A phrase is ``count`` windows from word ``start`` on. Its hash covers all
    its words through its first and its last window, which overlap.
    """
    seed = seed_length(window)
    for at in range(0, len(words) - window + 1, STRETCH):
        part = words[at:at + STRETCH + window - 1]
        seeds, windows = gram_hashes(part, seed), gram_hashes(part, window)
        least = sliding_argmin(seeds, window - seed + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        count = np.diff(np.append(first, len(least)))
        phrase = _joined(windows[first], windows[first + count - 1]) + count.astype(np.uint64)
        yield seeds[least[first]], phrase, first + at, count


def text_hashes(text: str | None, memo: dict) -> np.ndarray:
    parts = [np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)) for words in word_lists(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key, check): two hashes that rows share only if doc_id and text are equal."""
    cells = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text")]
    return docs.select("doc_id", "text", F.xxhash64(F.lit(1), *cells).alias("key"),
                       F.shiftrightunsigned(F.xxhash64(F.lit(2), *cells), 64 - _CHECK_BITS).alias("check"))


def _map_batches(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """``df`` mapped in small Arrow batches to the columns (lists or arrays) that the started function returns."""
    fields = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)
    types = [f.type for f in arrow]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                columns = compute(whole.slice(at, ROWS))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema=arrow)

    return df.mapInArrow(run, fields)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def _places(keyed: DataFrame, window: int) -> DataFrame:
    """(anchor, phrase, key, place) of every phrase; ``place`` packs the row's check, the phrase's count and start."""
    def start():
        memo = _WordHashes()

        def compute(batch: pa.RecordBatch) -> list:
            found = [[np.zeros(0, np.int64)] for _ in range(4)]
            for key, check, text in zip(*(batch.column(n).to_pylist() for n in ("key", "check", "text"))):
                for anchor, phrase, at, count in phrases_of(text_hashes(text, memo), window):
                    place = (check << (_COUNT_BITS + _START_BITS)) | (count << _START_BITS) | at
                    for own, new in zip(found, (_signed(anchor), _signed(phrase), np.full(len(at), key), place)):
                        own.append(new)
            return [np.concatenate(c) for c in found]

        return compute

    return _map_batches(keyed.select("key", "check", "text"), "anchor long, phrase long, key long, place long", start)


def unpacked(place: int) -> tuple[int, int, int]:
    """(check, count, start) of a place."""
    return (place >> (_COUNT_BITS + _START_BITS), place >> _START_BITS & (1 << _COUNT_BITS) - 1,
            place & (1 << _START_BITS) - 1)


def _phrase_texts(keyed: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """The rows of ``asked`` (key, place, anchor, phrase, n, size) with the words of each phrase, joined by blanks."""
    lists = asked.groupBy("key").agg(F.collect_list(F.struct("place", "anchor", "phrase", "n", "size")).alias("asked"))
    # Equal rows share a key; one of them has all that was asked.
    rows = keyed.select("key", "check", "text").join(lists, "key").dropDuplicates(["key", "check"])

    def start():
        def compute(batch: pa.RecordBatch) -> list:
            out = []
            for text, check, asked in zip(*(batch.column(n).to_pylist() for n in ("text", "check", "asked"))):
                data = text.encode()
                starts, ends = word_bounds(data)
                for a in asked:
                    own, count, at = unpacked(a["place"])
                    if own == check:
                        words = b" ".join(data[starts[at]:ends[at + count + window - 2]].split())
                        out.append((a["anchor"], a["phrase"], a["n"], a["size"], words.decode()))
            return list(zip(*out)) or [[]] * 5

        return compute

    return _map_batches(rows, "anchor long, phrase long, n long, size long, words string", start)


def longest_matches(text: np.ndarray, limit: int) -> np.ndarray:
    """For each place of ``text`` the most words from there on that also start at another place.

    ``text`` must hold a number of its own at every ``limit`` places or fewer
    and at its end; matches stop there. The suffix array comes from ranks of
    1, 2, 4, ... words, the prefixes that its neighbours share from the same
    ranks, longest first.
    """
    n, size = len(text), 1
    ranks = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
    while size < limit:
        behind = np.zeros(n, np.int64)
        behind[:max(n - size, 0)] = ranks[-1][size:] + 1
        ranks.append(np.unique(ranks[-1] * (n + 1) + behind, return_inverse=True)[1].astype(np.int64))
        size *= 2
    order = np.argsort(ranks[-1])
    left, right, common = order[:-1], order[1:], np.zeros(max(n - 1, 0), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        a, b = np.minimum(left + common, n - 1), np.minimum(right + common, n - 1)
        common += (ranks[level][a] == ranks[level][b]).astype(np.int64) << level
    matches = np.zeros(n, np.int64)
    matches[right] = common
    matches[left] = np.maximum(matches[left], common)
    return matches


def greedy_factors(matches: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the factors of all phrases: each takes the longest match, or a single word."""
    at, found = starts.copy(), []
    while (live := at < ends).any():
        length = np.maximum(1, np.minimum(matches[at[live]], ends[live] - at[live]))
        found.append((at[live], length))
        at[live] += length
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (starts, ends - starts)


def _marked(n: int, first: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in one of the ranges ``first:behind``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, behind, -1)
    return np.cumsum(steps[:n]) > 0


def duplicate_windows(phrases: list[list[bytes]], window: int) -> np.ndarray:
    """For each phrase of a reference block a mask of its windows that come elsewhere in the block.

    Factors of ``window`` words or more are duplicates. A duplicate window that
    no factor holds must cross the start of one, and crosses just one: the
    factor that starts in it reaches its end at least. So the windows across
    each factor's start are checked against the index.
    """
    numbers: dict[bytes, int] = {}
    lengths = np.array([len(p) for p in phrases], np.int64)
    text = np.zeros(int(lengths.sum()) + len(phrases), np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts + lengths
    for i, words in enumerate(phrases):
        text[starts[i]:ends[i]] = [numbers.setdefault(w, len(numbers)) for w in words]
    text[ends] = -1 - np.arange(len(phrases))
    matches = longest_matches(text, int(lengths.max(initial=0)) + 1)
    at, length = greedy_factors(matches, starts, ends)
    long = length >= window
    repeated = _marked(len(text), at[long], at[long] + length[long] - window + 1)
    owner = np.searchsorted(starts, at, "right") - 1
    border = np.flatnonzero(at > starts[owner])
    first = np.maximum(at[border] - window + 1, starts[owner[border]])
    repeated |= _marked(len(text), first, at[border]) & (matches >= window)
    places = np.flatnonzero(repeated)
    owner = np.searchsorted(starts, places, "right") - 1
    masks = np.zeros(len(phrases), np.int64)
    np.add.at(masks, owner, np.int64(1) << (places - starts[owner]))
    return masks


def _parsed(texts: DataFrame, window: int) -> DataFrame:
    """(anchor, phrase, mask) of the single phrases with a duplicate window, parsed block by block.

    Blocks are cut from rows sorted by anchor, at an anchor's end, so a block
    holds ``BLOCK_WORDS`` and one anchor's phrases at most.
    """
    schema = T._parse_datatype_string("anchor long, phrase long, mask long")
    arrow = to_arrow_schema(schema)

    def parsed(rows: list[tuple]) -> pa.RecordBatch:
        masks = duplicate_windows([r[3] for r in rows], window).tolist() if rows else []
        found = [(r[0], r[1], m) for r, m in zip(rows, masks) if m and r[2] == 1]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*found)) or [[]] * 3], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for anchor, phrase, n, words in zip(*(batch.column(c).to_pylist() for c in ("anchor", "phrase", "n", "words"))):
                if held >= BLOCK_WORDS and anchor != rows[-1][0]:
                    yield parsed(rows)
                    rows, held = [], 0
                if rows and rows[-1][:2] == (anchor, phrase):  # the same phrase, fetched from two rows with one key
                    continue
                rows.append((anchor, phrase, n, words.encode().split()))
                held += len(rows[-1][3])
        yield parsed(rows)

    dealt = texts.select("anchor", "phrase", "n", "words").repartition("anchor").sortWithinPartitions("anchor", "phrase")
    return dealt.mapInArrow(run, schema)


def _matched(texts: DataFrame, window: int) -> DataFrame:
    """(anchor, phrase, mask) for crowded anchors: windows are counted by hash, combined before they move."""
    def start():
        memo = _WordHashes()

        def compute(batch: pa.RecordBatch) -> list:
            found = [[np.zeros(0, np.int64)] for _ in range(5)]
            for anchor, phrase, n, words in zip(*(batch.column(c).to_pylist() for c in ("anchor", "phrase", "n", "words"))):
                hashes = _signed(gram_hashes(text_hashes(words, memo), window))
                columns = (np.full(len(hashes), anchor), np.full(len(hashes), phrase), np.full(len(hashes), n),
                           np.arange(len(hashes)), hashes)
                for own, new in zip(found, columns):
                    own.append(new)
            return [np.concatenate(c) for c in found]

        return compute

    windows = written(_map_batches(texts.dropDuplicates(["anchor", "phrase"]),
                                   "anchor long, phrase long, n long, i long, window long", start), "windows")
    repeated = windows.groupBy("anchor", "window").agg(F.sum("n").alias("all")).filter(F.col("all") > 1)
    return (windows.filter("n = 1").join(repeated, ["anchor", "window"]).groupBy("anchor", "phrase")
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(i AS INT))")).alias("mask")))


def duplicate_places(docs: DataFrame, window: int) -> DataFrame:
    """(key, place, mask) of all phrases with a duplicate window; keys and places as in ``_keyed`` and ``_places``."""
    keyed = _keyed(docs)
    places = written(_places(keyed, window), "places")  # cutting costs more than reading back: both readers share it
    anchors = places.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    met = written(places.join(anchors, "anchor", "left_semi"), "phrases")
    distinct = written(met.groupBy("anchor", "phrase").agg(
        F.count("*").alias("n"), F.min("key").alias("key"), F.min_by("place", "key").alias("place")), "distinct")
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("size")).filter("size > 1")
    texts = written(_phrase_texts(keyed, distinct.join(sizes, "anchor"), window), "texts")
    count = F.shiftright("place", _START_BITS).bitwiseAND(F.lit((1 << _COUNT_BITS) - 1)).cast("int")
    whole = distinct.filter("n > 1").select("anchor", "phrase", F.call_function("shiftleft", F.lit(1).cast("long"), count) - 1)
    single = _parsed(texts.filter(F.col("size") <= CROWD), window).union(_matched(texts.filter(F.col("size") > CROWD), window))
    return met.join(whole.toDF("anchor", "phrase", "mask").union(single), ["anchor", "phrase"]).select("key", "place", "mask")


def remove_duplicates(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, spans, kept) of every row.

    A word is removed if it lies in ``window`` consecutive words of its text
    that also start anywhere else, in the same text or another. ``spans`` holds
    the removed stretches (start, end) in words, ``kept`` the other words
    joined by one blank. Windows are judged on the input: all occurrences go.

    Null, empty and blank texts and texts shorter than the window lose nothing.
    Every row counts, so repeated rows and rows with equal or null ids are
    copies of each other. Other columns are ignored. An empty table gives no
    rows. Memory is a small multiple of the longest text, or a block.
    """
    hits = (duplicate_places(docs, window).groupBy("key")
            .agg(F.collect_set(F.struct("place", "mask")).alias("hits")))  # combined first: equal rows share a key
    rows = _keyed(docs).join(hits, "key", "left").select("doc_id", "text", "check", "hits")
    span = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end")])
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()),
                           T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.StringType())])
    arrow = to_arrow_schema(schema)

    def judge(text: str | None, check: int, hits: list | None) -> tuple[int, list, str]:
        data = (text or "").encode()
        n, starts = 0, []
        for hit in hits or ():
            own, _, at = unpacked(hit["place"])
            if own == check:
                starts += [at + i for i in range(hit["mask"].bit_length()) if hit["mask"] >> i & 1]
        if not starts:
            lists = [(len(words), b" ".join(words)) for words in word_lists(text) if words]
            return sum(n for n, _ in lists), [], b" ".join(part for _, part in lists).decode()
        first, last = word_bounds(data)
        n, starts = len(first), np.array(starts)
        gone = np.concatenate([[False], _marked(n, starts, starts + window), [False]])
        edges = np.flatnonzero(gone[1:] != gone[:-1])
        spans = [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]
        kept, at = [], 0
        for a, b in [*edges.reshape(-1, 2).tolist(), (n, n)]:
            if a > at:
                kept += [b" ".join(words) for words in word_lists(data[first[at]:last[a - 1]]) if words]
            at = b
        return n, spans, b" ".join(kept).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                out = [judge(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("text", "check", "hits")))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)] + [pa.array(c, f.type) for c, f in zip(zip(*out), list(arrow)[1:])], schema=arrow)

    return rows.mapInArrow(run, schema)
