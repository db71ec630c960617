"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece the last token of its BPE encoding is unique,
and a token is that last token exactly if the shorter prefix before it ends in
a token it may follow. Storing one last token per prefix therefore encodes a
piece from left to right, lets bytes be appended without looking back beyond
the longest token, and lets an edit keep all prefixes before it.
"""

from __future__ import annotations

import base64
import sys
import types
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.common import ROWS, map_texts

MEMO = 400_000
PAIR_MEMO = 200_000
REACH = 4  # a match of the pattern depends on at most this many characters behind its end


def load_ranks(spark: SparkSession, path: str) -> list[bytes]:
    """Token bytes in rank order, from a file of ``base64 rank`` lines; read once, by the driver.

    The file's size is the vocabulary's, so the list is small enough to send.
    """
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without a gap")
    return [ranks[i] for i in range(len(ranks))]


def merge_by_rank(piece: bytes, rank_of: dict[bytes, int]) -> list[bytes]:
    """Plain BPE: merge the lowest-ranked adjacent pair, leftmost first, until none is left."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        best = min(((rank_of[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank_of),
                   default=None)
        if best is None:
            return parts
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def halves_of(tokens: list[bytes]) -> list[tuple[int, int]]:
    """The two tokens that BPE merges last to make each token; (t, t) for single bytes, (-1, -1) if it never does."""
    rank_of = {token: i for i, token in enumerate(tokens)}
    out = []
    for i, token in enumerate(tokens):
        if len(token) == 1:
            out.append((i, i))
            continue
        lower = {k: r for k, r in ((token[a:b], rank_of.get(token[a:b])) for a in range(len(token))
                                   for b in range(a + 1, len(token) + 1)) if r is not None and r < i}
        parts = merge_by_rank(token, lower)
        out.append((rank_of[parts[0]], rank_of[parts[1]]) if len(parts) == 2 else (-1, -1))
    return out


class Vocabulary:
    """Ranks, and which token may follow which in an encoding."""

    def __init__(self, tokens: list[bytes], halves: list[tuple[int, int]]):
        self.tokens = tokens
        self.rank_of = {token: i for i, token in enumerate(tokens)}
        self.made = {token: i for i, token in enumerate(tokens) if halves[i][0] >= 0}  # tokens that merging can reach
        self.left = [a for a, _ in halves]
        self.right = [b for _, b in halves]
        self.merged = {a << 32 | b: i for i, (a, b) in enumerate(halves) if a != i and a >= 0}
        self.longest = max(map(len, tokens), default=1)
        self.pairs: dict[int, bool] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes leaves exactly these two; remembered.

        Their merges are undone from the last one backwards. As long as both
        tokens at the border stand, a token made of the two must not come
        before the merge that used one of them up: strictly before for the
        left one, up to the same rank for the right one, because equal ranks
        merge leftmost first.
        """
        if len(self.pairs) >= PAIR_MEMO:
            self.pairs.clear()
        key, halves_l, halves_r, merged = left << 32 | right, self.left, self.right, self.merged
        used_up = len(self.tokens)  # merges of lower rank find both border tokens standing
        while merged.get(left << 32 | right, used_up) >= used_up:
            left_is_byte, right_is_byte = halves_r[left] == left, halves_l[right] == right
            if left_is_byte and right_is_byte:
                self.pairs[key] = True
                return True
            if right_is_byte or (left > right and not left_is_byte):
                used_up, left = left, halves_r[left]
            else:
                used_up, right = right + 1, halves_l[right]
        self.pairs[key] = False
        return False


@dataclass
class Prefixes:
    """The last token of every byte prefix of a piece."""

    vocabulary: Vocabulary
    data: bytes = b""
    last: list[int] = field(default_factory=list)

    def append(self, more: bytes) -> Prefixes:
        """Add bytes; stored prefixes stay as they are."""
        v, data, last = self.vocabulary, self.data + more, self.last
        token_of, known, longest = v.made.get, v.pairs.get, v.longest
        for end in range(len(self.data) + 1, len(data) + 1):
            for start in range(end - longest if end > longest else 0, end):  # only one start is valid
                token = token_of(data[start:end])
                if token is None:
                    continue
                if start:
                    fits = known(last[start - 1] << 32 | token)
                    if not fits and (fits is not None or not v.may_follow(last[start - 1], token)):
                        continue
                last.append(token)
                break
        self.data = data
        return self

    def edit(self, start: int, end: int, replacement: bytes) -> Prefixes:
        """Replace bytes ``start:end``; prefixes up to ``start`` are kept."""
        rest = self.data[end:]
        return Prefixes(self.vocabulary, self.data[:start], self.last[:start]).append(replacement + rest)

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class _Lookup:
    """64-bit keys -> numbers for whole arrays; keys that meet in a slot go to the next, smaller table."""

    def __init__(self, keys: list[int], values: list[int]):
        self.tables = []
        keys, values, bits = np.array(keys, np.uint64), np.array(values, np.int32), 20
        while len(keys):
            slot = self._slots(keys, bits)
            _, first = np.unique(slot, return_index=True)
            held, number = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            held[slot[first]], number[slot[first]] = keys[first], values[first]
            self.tables.append((bits, held, number))
            rest = np.setdiff1d(np.arange(len(keys)), first)
            keys, values, bits = keys[rest], values[rest], max(12, bits - 2)

    @staticmethod
    def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29 + bits % 4))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, -1, np.int32)
        for bits, held, number in self.tables:
            slot = self._slots(keys, bits)
            hit = held[slot] == keys
            out = np.where(hit & (number[slot] >= 0), number[slot], out)
        return out


class PrefixTables:
    """The prefix tables of many pieces at once: position by position, for all pieces together."""

    LONGEST = 40  # longer pieces are rare; they go through ``Prefixes``
    _BASE = np.uint64(0x100000001B3)

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.left, self.right = np.array(v.left, np.int64), np.array(v.right, np.int64)
        self.sizes = np.array([len(t) for t in v.tokens], np.int64)
        self.merged = _Lookup(list(v.merged), list(v.merged.values()))
        known = {}
        for token, rank in v.made.items():
            if len(token) <= self.LONGEST:
                known.setdefault(self._hash(token), rank)
        if len(known) < sum(len(t) <= self.LONGEST for t in v.made):
            raise ValueError("two tokens share a hash")
        self.token = _Lookup(list(known), list(known.values()))

    def _hash(self, data: bytes) -> int:
        value = 0
        for byte in data:
            value = (value * int(self._BASE) + byte + 1) & 0xFFFFFFFFFFFFFFFF
        return value

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Vocabulary.may_follow`` for arrays of tokens."""
        out, open_ = np.zeros(len(left), bool), np.arange(len(left))
        left, right, used_up = left.astype(np.int64), right.astype(np.int64), np.full(len(left), len(self.sizes), np.int64)
        while len(open_):
            both = self.merged.get((left << 32 | right).view(np.uint64)).astype(np.int64)
            stand = (both < 0) | (both >= used_up)
            below_l, below_r = self.right[left], self.left[right]
            byte_l, byte_r = below_l == left, below_r == right
            out[open_[stand & byte_l & byte_r]] = True
            undo_l = byte_r | ((left > right) & ~byte_l)
            used_up = np.where(undo_l, left, right + 1)
            left, right = np.where(undo_l, below_l, left), np.where(undo_l, right, below_r)
            go = stand & ~(byte_l & byte_r)
            open_, left, right, used_up = open_[go], left[go], right[go], used_up[go]
        return out

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all pieces, and how many each has. Pieces are not empty."""
        n, lengths = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        top = int(lengths[0]) if n else 0
        data = np.zeros((top, n), np.uint64)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.append(0, np.cumsum(np.fromiter(map(len, pieces), np.int64, n)))[:-1][order]
        last = np.full((top, n), -1, np.int32)
        hashes = np.zeros((top, n), np.uint64)
        for at in range(top):
            m = int(np.searchsorted(-lengths, -at, "left"))  # pieces longer than at
            data[at, :m] = flat[starts[:m] + at]
            low = max(0, at + 1 - min(self.vocabulary.longest, self.LONGEST))
            hashes[low:at + 1, :m] = hashes[low:at + 1, :m] * self._BASE + data[at, :m] + np.uint64(1)
            ends_here = self.token.get(hashes[low:at + 1, :m])  # row s: the token from low + s to here
            open_ = np.arange(m)
            while len(open_):  # long tokens first; only one start is valid
                tried = ends_here[:, open_] >= 0
                start = tried.argmax(axis=0)
                token = ends_here[start, open_]
                before = low + start - 1
                fits = before < 0
                asked = np.flatnonzero(~fits)
                fits[asked] = self.may_follow(last[before[asked], open_[asked]], token[asked])
                last[at, open_[fits]] = token[fits]
                ends_here[start[~fits], open_[~fits]] = -1
                open_ = open_[~fits]
        found, at, alive = [], lengths.copy(), np.arange(n)
        while len(alive):
            token = last[at[alive] - 1, alive]
            found.append((alive, token))
            at[alive] -= self.sizes[token]
            alive = alive[at[alive] > 0]
        counts = np.zeros(n, np.int64)
        for rows, _ in found:
            counts[order[rows]] += 1
        ends, out = np.cumsum(counts), np.zeros(counts.sum(), np.int32)
        for k, (rows, token) in enumerate(found):
            out[ends[order[rows]] - 1 - k] = token
        return out, counts


class Encoder(dict):
    """Chunk or piece of text -> index into flat ids; up to about ``MEMO`` are remembered.

    A text may be cut before every single blank that has no white space beside
    it: there, patterns of this family start a new match. The chunks between
    such cuts recur, so most are looked up whole.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__()
        self.vocabulary, self.tables = vocabulary, PrefixTables(vocabulary)
        self.find, self.finditer = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.beside = regex.compile(r"\s\s").search
        self.flat, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text]).to_pylist()[0]

    def chunks(self, text: str) -> list[str]:
        if " " not in text or self.beside(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + chunk for chunk in rest]

    def _learn(self, chunks: list[str]) -> None:
        """Encode unknown chunks: their unknown pieces first, then chunks of several pieces from those."""
        fresh, several = {}, []
        for chunk in chunks:
            pieces = self.find(chunk)
            if pieces != [chunk]:
                several.append((chunk, pieces))
            for piece in pieces:
                if piece not in self:
                    fresh[piece] = None
        by_kind = ([], [], [])
        for piece in fresh:
            data = piece.encode()  # a piece that is a token needs no merging
            by_kind[0 if data in self.vocabulary.rank_of else 1 if len(data) <= PrefixTables.LONGEST else 2].append(piece)
        self._keep(by_kind[0], np.fromiter((self.vocabulary.rank_of[p.encode()] for p in by_kind[0]), np.int32,
                                           len(by_kind[0])), np.ones(len(by_kind[0]), np.int64))
        self._keep(by_kind[1], *self.tables.ids([p.encode() for p in by_kind[1]]))
        for piece in by_kind[2]:
            ids = Prefixes(self.vocabulary).append(piece.encode()).ids()
            self._keep([piece], np.array(ids, np.int32), np.array([len(ids)]))
        parts, owner = [], []
        for k, (_, pieces) in enumerate(several):
            parts += map(self.__getitem__, pieces)
            owner += [k] * len(pieces)
        ids, sizes = self._gather(np.array(parts, np.int64))
        self._keep([chunk for chunk, _ in several], ids,
                   np.bincount(np.array(owner, np.int64), sizes, len(several)).astype(np.int64))

    def _gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of remembered entries, and how many each has."""
        sizes = self.ends[entries + 1] - self.ends[entries]
        stops = np.cumsum(sizes)
        source = np.repeat(self.ends[entries] - (stops - sizes), sizes) + np.arange(sizes.sum())
        return self.flat[source], sizes

    def _keep(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, last = len(self), len(self) + len(names)
        self.update(zip(names, range(first, last)))
        start = self.ends[first]
        if last >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(self.ends), last), np.int64)])
        if start + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
        self.ends[first + 1:last + 1] = start + np.cumsum(sizes)
        self.flat[start:start + len(ids)] = ids

    def encode_batch(self, texts: list[str | None]) -> pa.ListArray:
        """Ids of each text (null: empty), gathered from the remembered chunks without a loop over tokens."""
        if len(self) >= MEMO:
            self.clear()
        cut = [self.chunks(t or "") for t in texts]
        if unknown := list(dict.fromkeys(c for chunks in cut for c in chunks if c not in self)):
            self._learn(unknown)
        look = self.__getitem__
        found = [np.array(list(map(look, chunks)), np.int64) for chunks in cut]
        ids, sizes = self._gather(np.concatenate(found) if found else np.zeros(0, np.int64))
        stops = np.append(0, np.cumsum(sizes))
        offsets = stops[np.append(0, np.cumsum([len(f) for f in found])).astype(np.int64)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))

    def continue_at(self, text: str, edited: int, kept_end: int) -> int:
        """Where a known piece starts from which ``text`` must be split anew if it changes at ``edited``."""
        return max((m.start() for m in self.finditer(text) if m.end() <= min(kept_end, edited - REACH)), default=0)


def _tokeniser(spark: SparkSession, path: str):
    tokens = load_ranks(spark, path)
    return spark.sparkContext.broadcast((tokens, halves_of(tokens)))  # the vocabulary's size


def _encoder(sent, path: str, pattern: str) -> Encoder:
    """This process's encoder: Spark reuses its Python workers, so later tasks find it with its memory."""
    kept = sys.modules.setdefault("_llm_encoders", types.ModuleType("_llm_encoders")).__dict__
    key = f"{path} {pattern}"
    if key not in kept:
        kept[key] = Encoder(Vocabulary(*sent.value), pattern)
    return kept[key]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with the text column replaced by ``ids`` (array<int>), the whole text's tokens.

    Null and empty texts have no ids. Each match of ``pattern`` is encoded by
    itself and no special token is known.
    """
    sent = _tokeniser(docs.sparkSession, path)

    def start():
        encoder = _encoder(sent, path, pattern)

        return lambda texts: [encoder.encode_batch(texts)]

    return map_texts(docs, [("ids", T.ArrayType(T.IntegerType()))], start)


def decoded(ids: pa.ListArray, vocabulary: pa.BinaryArray) -> pa.BinaryArray:
    """The bytes of each list of ids: tokens are taken for all lists at once and their buffer is cut anew."""
    flat = vocabulary.take(ids.flatten())
    if not len(flat):
        return pc.if_else(ids.is_null(), pa.scalar(None, pa.binary()), pa.scalar(b"", pa.binary()))
    sizes = np.append(0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    starts = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1, flat.offset * 4)
    offsets = pa.py_buffer(starts[sizes].astype(np.int32).tobytes())
    joined = pa.Array.from_buffers(pa.binary(), len(ids), [None, offsets, flat.buffers()[2]])
    return pc.if_else(ids.is_null(), pa.scalar(None, pa.binary()), joined)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the bytes its ``ids`` stand for, as ``decoded`` (binary); null ids give null.

    An id outside the vocabulary is an error.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(load_ranks(encoded.sparkSession, path))
    encoded = encoded.drop("decoded")
    schema = T.StructType(encoded.schema.fields + [T.StructField("decoded", T.BinaryType())])

    def run(batches):
        vocabulary = pa.array(sent.value, pa.binary())
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*batch.columns, decoded(batch.column("ids"), vocabulary)],
                                                 names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def encode_edited(edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """``ids`` of texts that were edited, keeping the tokens in front of the edit.

    Rows have ``text`` and its ``ids``, and the edit: ``start`` (code point
    where the texts begin to differ, their length for an append) and
    ``edited`` (the whole new text). All other columns pass through; ``ids``
    becomes that of the edited text. Pieces that end well before ``start``
    keep their tokens; the rest is split and encoded anew. Nulls count as
    empty texts and as an edit at the start.
    """
    sent = _tokeniser(edits.sparkSession, path)
    kept = [f for f in edits.schema.fields if f.name not in ("text", "start", "edited", "ids")]
    schema = T.StructType(kept + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        encoder = Encoder(Vocabulary(*sent.value), pattern)
        for batch in batches:
            out = []
            for text, ids, start, edited in zip(*(batch.column(c).to_pylist() for c in ("text", "ids", "start", "edited"))):
                out.append(reencode(encoder, text or "", ids, start or 0, edited or ""))
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(out, pa.list_(pa.int32()))],
                                             names=schema.fieldNames())

    return edits.mapInArrow(run, schema)


def reencode(encoder: Encoder, text: str, ids: list[int] | None, start: int, edited: str) -> list[int]:
    """Ids of ``edited``, which equals ``text`` up to code point ``start``."""
    if ids is None:
        return encoder.encode(edited)
    at = encoder.continue_at(text, start, len(text) - 1)
    n_bytes, n = len(text[:at].encode()), 0
    while n_bytes > 0:
        n_bytes -= len(encoder.vocabulary.tokens[ids[n]])
        n += 1
    return ids[:n] + encoder.encode(edited[at:])


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids`` and, decoded from these, ``decoded`` in place of text: ``encode`` and ``decode`` in one pass."""
    sent = _tokeniser(docs.sparkSession, path)

    def start():
        encoder, vocabulary = _encoder(sent, path, pattern), pa.array(sent.value[0], pa.binary())

        def compute(texts):
            ids = encoder.encode_batch(texts)
            return [ids, decoded(ids, vocabulary)]
        return compute

    return map_texts(docs, [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.BinaryType())], start)


def digest(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """``docs`` without text, with n_tokens and the digests of the ids and of the decoded bytes; ids if asked for."""
    whole = round_trip(docs, path, pattern)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return (whole.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("ids_sha256", F.sha2(joined, 256))
            .withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded", *[] if keep_ids else ["ids"]))
