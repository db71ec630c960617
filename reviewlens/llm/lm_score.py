"""Stupid-backoff language-model scores, computed relationally.

The model is the corpus itself: word and bigram counts over all documents,
where a document does not vouch for its own bigrams. Documents are taken in
chunks; a chunk sends its bigrams, sorted and packed, to the buckets of their
keys, one row for each chunk and bucket. A bucket counts its bigrams over all
chunks and returns what they add to each document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import ROWS, word_blocks, written

ALPHA = 0.4
COMMON_BITS = 20       # words of a share of 2^-20 and above have an id and a count in every task, others go by their hash
VOCABULARY_BITS = None  # if given (at most COMMON_BITS), words below a share of 2^-VOCABULARY_BITS are one unknown word
HOT_BITS, SAMPLE = 16, 16  # not used any more: frequent bigrams need no count of their own (a test still sets both)
ID_BITS = COMMON_BITS + 1
CHUNK_WORDS, CHUNK_ROWS = 1 << 21, 1 << 14  # a chunk of documents ends at so many words, or rows
BUCKET_WORDS, BUCKET_BITS = 1 << 21, 8  # words for each bucket of bigrams, and bits of the least number of buckets
HELD = 1 << 22         # scores that a task adds up before it hands them on
MEMO = 200_000
CHUNK = 1 << 20
_KEY_BITS = 2 * ID_BITS
_KEY_MASK = np.uint64((1 << _KEY_BITS) - 1)
_STEPS = tuple(np.uint64(x & ((1 << _KEY_BITS) - 1)) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))  # odd, so they have inverses
_BACK = tuple(np.uint64(pow(int(x), -1, 1 << _KEY_BITS)) for x in _STEPS)
_WORD_BITS = 63
_START = 1 << ID_BITS  # stands before the first word
OWN, COMMON, MIXED, RARE = range(4)  # what a row holds: a chunk's documents; bigrams of two common words, one, none


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


class _Hashes(dict):
    """Word -> hash, remembered up to ``MEMO`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = value = _word_hash(word)
        return value


@dataclass
class Vocabulary:
    """Hashes of the common words, ascending, their ids (1 is the most frequent), counts by id (0: unknown)."""

    hashes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    tokens: int
    whole: bool

    def ids_of(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the words with these hashes, or below 0 the complement of a rare word's hash."""
        at = _position(self.hashes, hashes)
        known = self.ids[at] if len(self.ids) else at
        return np.where(at >= 0, known, ~hashes if self.whole else 0)

    def logarithms(self) -> np.ndarray:
        return np.log(np.maximum(self.counts, 1))

    def bucket_bits(self) -> int:
        return max(BUCKET_BITS, (self.tokens // BUCKET_WORDS).bit_length())


def _position(ascending: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key, -1 if absent."""
    if not len(ascending):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(ascending, keys), len(ascending) - 1)
    return np.where(ascending[at] == keys, at, -1)


def _word_counts(docs: DataFrame) -> DataFrame:
    """(key, n) of every word; a task adds up its own words, about a million at a time, before the shuffle."""
    def run(batches):
        memo = _Hashes()

        def sent(parts):
            keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

        pending, size, parts = [], 0, []
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for words in word_blocks(text):
                    pending.append(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)))
                    size += len(words)
                if size >= CHUNK:
                    parts.append(np.unique(np.concatenate(pending), return_counts=True))
                    pending, size = [], 0
                    if sum(len(k) for k, _ in parts) > 4 * CHUNK:
                        yield sent(parts)
                        parts = []
        if pending:
            parts.append(np.unique(np.concatenate(pending), return_counts=True))
        if parts:
            yield sent(parts)

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Words of at least 2^-``COMMON_BITS`` of all tokens, so at most 2^``COMMON_BITS``; all others are rare."""
    counts = written(_word_counts(docs), "words")
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    bits = COMMON_BITS if VOCABULARY_BITS is None else VOCABULARY_BITS
    common = counts.filter(F.col("n") * (1 << bits) >= tokens).toArrow()
    keys, n = (common.column(c).to_numpy() for c in ("key", "n"))
    order = np.lexsort((keys, -n))
    ids = np.empty(len(keys), np.int64)
    ids[order] = np.arange(1, len(keys) + 1)
    ascending = np.argsort(keys)
    return Vocabulary(keys[ascending], ids[ascending], np.concatenate([[tokens - n.sum()], n[order]]).astype(np.int64),
                      int(tokens), VOCABULARY_BITS is None)


def _spread(keys: np.ndarray) -> np.ndarray:
    """Keys of ``_KEY_BITS`` bits, one to one, so that their high bits deal them out evenly."""
    half = np.uint64(ID_BITS)
    mixed = keys.astype(np.uint64) * _STEPS[0] & _KEY_MASK
    return (mixed ^ mixed >> half) * _STEPS[1] & _KEY_MASK


def _gathered(mixed: np.ndarray) -> np.ndarray:
    """Undoes ``_spread``."""
    mixed = mixed * _BACK[1] & _KEY_MASK
    return ((mixed ^ mixed >> np.uint64(ID_BITS)) * _BACK[0] & _KEY_MASK).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first, without the high bytes that none of them has."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :data[0]] = planes.T
    return out.view(np.uint64).ravel()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, words of each row, hashes of all words) of so many rows at a time."""
    memo = _Hashes()
    ids, lengths, parts, size = [], [], [], 0

    def taken():
        return pa.concat_arrays(ids), np.array(lengths), np.concatenate([np.zeros(0, np.int64), *parts])

    for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
        column, begun = batch.column("doc_id"), 0
        for i, text in enumerate(batch.column("text").to_pylist()):
            found = [np.fromiter(map(memo.__getitem__, words), np.int64, len(words)) for words in word_blocks(text)]
            parts += found
            lengths.append(sum(map(len, found)))
            size += lengths[-1]
            if size >= CHUNK_WORDS or len(lengths) >= CHUNK_ROWS:
                ids.append(column.slice(begun, i + 1 - begun))
                yield taken()
                ids, lengths, parts, size, begun = [], [], [], 0, i + 1
        if begun < batch.num_rows:
            ids.append(column.slice(begun))
    if lengths:
        yield taken()


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where in sorted columns a new row of values begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    changed = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        changed |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate([[True], changed]))


def _common_pairs(a: np.ndarray, b: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, other, row) of bigrams of two common words, sorted; the key has both, ``other`` is 0."""
    bits = np.uint64(max(1, int(row.max(initial=0)).bit_length()))
    both = np.sort(_spread(a << ID_BITS | b) << bits | row.astype(np.uint64))  # 42 and at most 14 bits
    return both >> bits, np.zeros(len(both), np.uint64), (both & ((np.uint64(1) << bits) - np.uint64(1)))


def _rare_pairs(word: np.ndarray, other: np.ndarray, is_first: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, other, row) of bigrams dealt out by a rare word, sorted; the lowest bit of ``other`` tells if that comes first."""
    key = (~word).astype(np.uint64)
    other = np.where(other < 0, ~other, other).astype(np.uint64) << np.uint64(1) | is_first.astype(np.uint64)
    order = np.lexsort((row, other, key))
    return key[order], other[order], row[order].astype(np.uint64)


def _requests(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """A row for each chunk and bucket with bigrams in it, by kind, and one for the chunk's documents.

    ``keys`` are the differences of ascending keys, ``others`` what they do not
    tell, ``held`` how many documents of the chunk hold each; ``rows`` and
    ``times`` name these documents and how often. A bigram of two rare words
    goes to the buckets of both: that of the first word scores it if other
    documents have it, else that of the second.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((words.hashes, words.ids, words.counts, words.tokens, words.whole))
    bucket_bits = words.bucket_bits()
    names = ["bucket", "kind", "chunk", "n", "keys", "others", "held", "rows", "times", "ids", "n_tokens"]

    def cut(kind: int, width: int, key: np.ndarray, other: np.ndarray, row: np.ndarray) -> Iterator[tuple]:
        begins = _runs(key, other, row)
        times = np.diff(np.append(begins, len(row)))
        key, other, row = key[begins], other[begins], row[begins]
        begins = _runs(key, other)
        held, ends = np.diff(np.append(begins, len(row))), np.append(begins, len(row))
        key, other = key[begins], other[begins]
        shift = np.uint64(width - bucket_bits)
        bucket, low = (key >> shift).astype(np.int64), key & ((np.uint64(1) << shift) - np.uint64(1))
        edges = np.append(_runs(bucket), len(bucket))
        for i, j in zip(edges[:-1], edges[1:]):
            p, q = ends[i], ends[j]
            yield (int(bucket[i]), kind, packed(np.diff(low[i:j], prepend=np.uint64(0))), packed(other[i:j]), packed(held[i:j]),
                   packed(row[p:q]), packed(times[p:q]))

    def run(batches):
        known = Vocabulary(*sent.value)
        logs, partition = known.logarithms(), TaskContext.get().partitionId()
        for number, (ids, lengths, hashes) in enumerate(_chunks(batches)):
            found, row = known.ids_of(hashes), np.repeat(np.arange(len(lengths)), lengths)
            opening = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
            before = np.concatenate([[_START], found[:-1]]) if len(row) else found
            before[opening] = _START
            base, known_first = np.zeros(len(lengths)), opening[found[opening] >= 0]
            base[row[known_first]] = logs[found[known_first]] - np.log(known.tokens)
            one, both = found < 0, (before < 0) & (found < 0)
            common, late, early = ~one & (before >= 0) & (before != _START), one & ~both, ~one & (before < 0)
            mixed = _rare_pairs(*(np.concatenate(x) for x in (
                (found[late], before[early]), (before[late], found[early]),
                (np.zeros(late.sum(), bool), np.ones(early.sum(), bool)), (row[late], row[early]))))
            rare = _rare_pairs(*(np.concatenate(x) for x in (
                (found[both], before[both]), (before[both], found[both]),
                (np.zeros(both.sum(), bool), np.ones(both.sum(), bool)), (row[both], row[both]))))
            out = [*cut(COMMON, _KEY_BITS, *_common_pairs(before[common], found[common], row[common])),
                   *cut(MIXED, _WORD_BITS, *mixed), *cut(RARE, _WORD_BITS, *rare)]
            chunk, n = partition << 32 | number, len(out) + 1
            buckets, kinds, *blobs = zip(*out) if out else ((),) * 7
            yield pa.RecordBatch.from_arrays([
                pa.array([chunk % (1 << bucket_bits), *buckets], pa.int64()), pa.array([OWN, *kinds], pa.int32()),
                pa.array(np.full(n, chunk)), pa.array(np.full(n, len(lengths))),
                *[pa.array([b"", *x], pa.binary()) for x in blobs[:-1]], pa.array([base.tobytes(), *blobs[-1]], pa.binary()),
                *[pa.concat_arrays([pa.ListArray.from_arrays([0, len(x)], x), pa.nulls(n - 1, pa.list_(x.type))])
                  for x in (ids, pa.array(lengths, pa.int64()))]], names=names)

    return docs.select("doc_id", "text").mapInArrow(
        run, "bucket long, kind int, chunk long, n long, keys binary, others binary, held binary, rows binary, times binary, "
        f"ids array<{id_type}>, n_tokens array<long>")


@dataclass
class _Slice:
    """The bigrams of one chunk and kind in a bucket; ``sums`` are their counts in the chunk."""

    chunk: int
    n: int
    keys: np.ndarray
    others: np.ndarray
    held: np.ndarray
    rows: np.ndarray
    times: np.ndarray
    sums: np.ndarray


def _slice(chunk: int, n: int, *blobs: bytes) -> _Slice:
    keys, others, held, rows, times = map(unpacked, blobs)
    held, times = held.astype(np.int64), times.astype(np.int64)
    return _Slice(chunk, n, np.cumsum(keys, dtype=np.uint64), others, held, rows.astype(np.int64), times,
                  np.add.reduceat(times, np.cumsum(held) - held))


def log_score(n: np.ndarray, own: np.ndarray, seen: np.ndarray, unseen: np.ndarray) -> np.ndarray:
    """ln of a bigram's stupid-backoff score, given its count, the document's own, and what is added to ln(n - own)
    if other documents have it, or stands for it if none has."""
    return np.where(n > own, np.log(np.maximum(n - own, 1)) + seen, unseen)


def _counted(slices: list[_Slice], pair: np.ndarray) -> np.ndarray:
    """Counts over all chunks of the bigrams that ``pair`` numbers."""
    return np.bincount(pair, np.concatenate([s.sums for s in slices])).astype(np.int64)[pair]


def _scored(slices: list[_Slice], n: np.ndarray, *terms: np.ndarray, take: np.ndarray | None = None) -> Iterator[tuple]:
    """(chunk, n, scores of its documents), slice by slice; ``terms`` as in ``log_score``, where ``take`` says no, only
    the terms count."""
    at = 0
    for s in slices:
        part = slice(at, at + len(s.keys))
        at += len(s.keys)
        n_all, seen, unseen = (np.repeat(x[part], s.held) for x in (n, *terms))
        v = log_score(n_all, s.times, seen, unseen)
        if take is not None:
            v = np.where(np.repeat(take[part], s.held) | (n_all <= s.times), v, seen)
        yield s.chunk, s.n, np.bincount(s.rows, s.times * v, s.n)


def _bucket_scores(bucket: int, kinds: dict[int, list[_Slice]], logs: np.ndarray, tokens: int, bucket_bits: int) -> Iterator[tuple]:
    backoff = np.log(ALPHA / max(1, tokens))
    if common := kinds.get(COMMON):
        keys, pair = np.unique(np.concatenate([s.keys for s in common]), return_inverse=True)
        keys = _gathered(keys | np.uint64(bucket << (_KEY_BITS - bucket_bits)))
        yield from _scored(common, _counted(common, pair), -logs[keys >> ID_BITS][pair],
                           logs[keys & (1 << ID_BITS) - 1][pair] + backoff)
    slices = kinds.get(MIXED, []) + kinds.get(RARE, [])
    if not slices:
        return
    # Every place of a rare word is in its bucket once as the second word, or as the first of its text.
    others = np.concatenate([s.others for s in slices])
    is_first, sums = (others & np.uint64(1)) == 1, np.concatenate([s.sums for s in slices])
    words, word = np.unique(np.concatenate([s.keys for s in slices]), return_inverse=True)
    log_n = np.log(np.bincount(word, np.where(is_first, 0, sums), len(words)))[word]
    n_mixed = sum(len(s.keys) for s in kinds.get(MIXED, []))
    if n_mixed:
        here = slice(0, n_mixed)
        other = others[here].astype(np.int64) >> 1
        pair = np.unique(word[here] << (ID_BITS + 2) | others[here].astype(np.int64), return_inverse=True)[1]
        start = other == _START
        log_other = logs[np.where(start, 0, other)]
        opening = log_n[here] - np.log(max(1, tokens))
        seen = np.where(start, opening, np.where(is_first[here], -log_n[here], -log_other))
        unseen = np.where(start, opening, backoff + np.where(is_first[here], log_other, log_n[here]))
        yield from _scored(kinds[MIXED], _counted(kinds[MIXED], pair), seen, unseen, take=~start)
    if kinds.get(RARE):
        here = slice(n_mixed, None)
        named, other = np.unique(others[here], return_inverse=True)
        pair = np.unique(word[here] * len(named) + other, return_inverse=True)[1]
        seen = np.where(is_first[here], -log_n[here], 0.0)
        unseen = np.where(is_first[here], 0.0, backoff + log_n[here])
        yield from _scored(kinds[RARE], _counted(kinds[RARE], pair), seen, unseen, take=is_first[here])


def _answers(requests: DataFrame, words: Vocabulary) -> DataFrame:
    """(chunk, ids, n_tokens, v): the documents of a chunk with what needs no count, and scores of theirs from the buckets.

    A task holds one bucket at a time and adds up the scores of all its buckets.
    """
    id_type = requests.schema["ids"].dataType.simpleString()
    sent = requests.sparkSession.sparkContext.broadcast((words.logarithms(), words.tokens, words.bucket_bits()))
    ids_at = requests.columns.index("ids")

    def run(batches):
        logs, tokens, bucket_bits = sent.value
        sums, held, kinds, last = {}, 0, {}, None
        list_types = None

        def added() -> int:
            new = 0
            for chunk, n, v in _bucket_scores(last, kinds, logs, tokens, bucket_bits):
                if chunk in sums:
                    sums[chunk] += v
                else:
                    sums[chunk], new = v, new + n
            return new

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int64()), *[pa.nulls(len(sums), t) for t in list_types],
                 pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["chunk", "ids", "n_tokens", "v"])

        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            list_types = [batch.column(k).type for k in (ids_at, ids_at + 1)]
            own = batch.filter(pa.array(batch.column("kind").to_numpy() == OWN))
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column(c) for c in ("chunk", "ids", "n_tokens", "times")],
                                                 names=["chunk", "ids", "n_tokens", "v"])
            columns = (batch.column(k).to_pylist() for k in range(ids_at))
            for bucket, kind, chunk, n, *blobs in zip(*columns):
                if kind == OWN:
                    continue
                if bucket != last:
                    held += added()
                    kinds, last = {}, bucket
                    if held >= HELD:
                        yield handed()
                        sums, held = {}, 0
                kinds.setdefault(kind, []).append(_slice(chunk, n, *blobs))
        added()
        if sums:
            yield handed()

    dealt = requests.repartition("bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(run, f"chunk long, ids {id_type}, n_tokens array<long>, v binary")


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_score) of every document against counts over all documents.

    Tokens are words without ASCII white space, A-Z lower-cased; every word
    counts as itself (see ``VOCABULARY_BITS``). A bigram scores (n - own) /
    n(first word) if other documents have it, n being its count and ``own``
    the document's; else ``ALPHA`` n(second word) / N. The first word scores
    n / N. ``log_score`` is the sum of natural logarithms. Null, empty and
    blank texts have no tokens, log_score 0 and a null mean. Rows that share a
    doc_id are scored one by one and added up. Documents are named by their
    place in a chunk, so a task that runs again must meet its rows in the same
    order, as it does if they are read from files.
    """
    words = vocabulary(docs)
    answers = _answers(_requests(docs, words), words)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def summed(table: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(x, np.float64) for x in table.column("v").to_pylist())
        ids, n_tokens = (table.column(c).combine_chunks().flatten() for c in ("ids", "n_tokens"))
        return pa.table({"doc_id": ids, "n_tokens": n_tokens, "log_score": pa.array(v, pa.float64())})

    by_row = answers.groupBy("chunk").applyInArrow(summed, f"doc_id {id_type}, n_tokens long, log_score double")
    done = by_row.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("log_score").alias("log_score"))
    return done.withColumn("mean_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")))
