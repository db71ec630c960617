"""Cross-tokenizer alignment with an identity map as fast path.

Two tokenizers cut the same bytes. Byte offsets where tokens of both end cut a
text into groups; every pair of tokens that share a byte is linked. For each
pair of ids, the number of documents that hold it linked is counted over the
corpus, and documents are then rated by those counts.

Most groups are one token against one of the same bytes. A map from A's id to
the B id of the same bytes, computed once, tells such links by the A id alone,
so their documents are counted in vectors of the vocabulary's length, one for
each task. Only the links of irregular groups are counted by pair in a shuffle.
The counts come back the same way: the vectors, and the pairs that make up at
least 2^-16 of all, of which there are 2^16 at most, go to every task; the
other pairs are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from reviewlens.llm.common import ROWS, written

CHUNK = 1 << 16  # characters from which on a text is cut at the next safe blank
BLOCK = 1 << 20  # characters that are aligned at once, give or take a chunk
FREQUENT = 1 << 16  # a pair with more than this share's inverse of all (document, pair) rows is counted in every task
_ID_BITS = 20


@dataclass
class Vocabulary:
    """The bytes of every token, and what starts an encoder of texts in a task."""

    tokens: list[bytes]
    start: Callable[[], Callable[[list[str]], list[list[int]]]]

    def __post_init__(self):
        if len(self.tokens) > 1 << _ID_BITS:
            raise ValueError(f"ids must have {_ID_BITS} bits at most")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level(path: str, pattern: str) -> Vocabulary:
    """A byte-level BPE vocabulary file; its entries' ids are their ranks. Special tokens are ordinary text.

    The file is read once, by the driver. Texts are encoded with a blank in front.
    """
    byte_of, file = byte_alphabet(), Tokenizer.from_file(path)
    special = {i for i, t in file.get_added_tokens_decoder().items() if t.special}
    entries = sorted((i, t) for t, i in file.get_vocab().items())
    if [i for i, _ in entries] != list(range(len(entries))):
        raise ValueError("ids must run from 0 without a gap")
    tokens = [t.encode() if i in special else bytes(byte_of[c] for c in t) for i, t in entries]

    def start():
        ranks = {t: i for i, t in enumerate(tokens) if i not in special}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [encoding.encode_ordinary(" " + t) for t in texts]

    return Vocabulary(tokens, start)


def pieces(path: str) -> Vocabulary:
    """A sentence-piece model with byte fallback that puts a blank in front itself; read once, by the driver."""
    with open(path, "rb") as file:
        model = file.read()
    known = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [known.id_to_piece(i) for i in range(known.get_piece_size())]
    if any("▁" in name.lstrip("▁") for name in names):
        raise ValueError("a piece must not go on behind a word's end: long texts are cut there")
    tokens = [bytes([int(name[3:5], 16)]) if known.is_byte(i) else name.replace("▁", " ").encode()
              for i, name in enumerate(names)]

    def start():
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: processor.encode(texts, num_threads=1)

    return Vocabulary(tokens, start)


def chunks_of(text: str) -> list[str]:
    """``text`` cut at single blanks between other characters, which are dropped: encoders put one in front of each chunk.

    No token of either kind crosses such a place. A text without one stays whole.
    """
    out, at, look = [], 0, CHUNK
    while at + look < len(text):
        cut = text.find(" ", at + look, len(text) - 1)
        if cut < 0:
            break
        if text[cut - 1].isspace() or text[cut + 1].isspace():
            look = cut + 1 - at
            continue
        out.append(text[at:cut])
        at, look = cut + 1, CHUNK
    return [*out, text[at:]]


def _digit_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1 in rows filled up with zero bytes, and their numbers."""
    texts = [str(i).encode() for i in range(n)]
    width = max(map(len, texts), default=1)
    return (np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(n, width),
            np.array([len(t) for t in texts], np.int64))


@dataclass
class Part:
    """What alignment finds in a text, or in a stretch of a long one."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    same: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # A ids linked to the B id of the same bytes
    same_times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # other links: A id << 20 | B id
    pair_times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    groups: bytes = b""


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, times = np.concatenate(keys), np.concatenate(times)
    out, where = np.unique(keys, return_inverse=True)
    return out, np.bincount(where, times, len(out)).astype(np.int64)


def together(parts: list[Part]) -> Part:
    """The parts of one text as one."""
    if len(parts) == 1:
        return parts[0]
    same, same_times = _summed([p.same for p in parts], [p.same_times for p in parts])
    pairs, pair_times = _summed([p.pairs for p in parts], [p.pair_times for p in parts])
    return Part(*(sum(getattr(p, n) for p in parts) for n in ("n_a", "n_b", "n_groups", "n_links")),
                same, same_times, pairs, pair_times, b";".join(p.groups for p in parts))


class Aligner:
    """Aligns whole blocks of texts at once."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.vocabularies = (a, b)
        self.encoders = (a.start(), b.start())
        self.sizes = tuple(np.array([len(t) for t in v.tokens], np.int64) for v in (a, b))
        self.digits = tuple(_digit_table(len(v.tokens)) for v in (a, b))
        by_bytes = {t: i for i, t in enumerate(b.tokens)}  # the last of equal ones: whole pieces follow fallback bytes
        self.same = np.array([by_bytes.get(t, -1) for t in a.tokens], np.int64)  # the identity map

    def block(self, stretches: list[list[str]]) -> list[Part | None]:
        """A part for each list of chunks; None where joined tokens differ from the text."""
        counts = [len(chunks) for chunks in stretches]
        flat = list(chain.from_iterable(stretches))
        ids, kept = ([], []), []
        encoded = [encode(flat) for encode in self.encoders]
        at = 0
        for i, n in enumerate(counts):
            own = [list(chain.from_iterable(e[at:at + n])) for e in encoded]
            expected = b"".join(b" " + c.encode() for c in flat[at:at + n])
            at += n
            if all(b"".join(map(v.tokens.__getitem__, o)) == expected for v, o in zip(self.vocabularies, own)):
                kept.append(i)
                for all_ids, o in zip(ids, own):
                    all_ids.append(np.array(o, np.int64))
        out: list[Part | None] = [None] * len(stretches)
        if kept:
            for i, part in zip(kept, self._aligned(*ids)):
                out[i] = part
        return out

    def _aligned(self, a_lists: list[np.ndarray], b_lists: list[np.ndarray]) -> Iterator[Part]:
        a, b = np.concatenate(a_lists), np.concatenate(b_lists)
        a_ends, b_ends = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        a_count, b_count = (np.cumsum([0] + [len(x) for x in lists]) for lists in (a_lists, b_lists))
        part_ends = a_ends[a_count[1:] - 1]
        a_at, b_at = np.zeros(int(a_ends[-1]) + 1, bool), np.zeros(int(a_ends[-1]) + 1, bool)
        a_at[a_ends], b_at[b_ends] = True, True
        a_done, b_done = np.cumsum(a_at, dtype=np.int32), np.cumsum(b_at, dtype=np.int32)  # tokens that end up to here
        # Between two neighbouring ends of either kind one token of each lies: a link.
        cuts = np.flatnonzero(a_at | b_at)
        left, right = a[a_done[cuts] - a_at[cuts]], b[b_done[cuts] - b_at[cuts]]
        link_edge = np.concatenate([[0], np.searchsorted(cuts, part_ends, "right")])
        owner = np.repeat(np.arange(len(part_ends)), np.diff(link_edge))
        ends = np.flatnonzero(a_at & b_at)
        group_edge = np.concatenate([[0], np.searchsorted(ends, part_ends, "right")])
        is_same = self.same[left] == right
        same, same_times, same_edge = _per_owner(owner[is_same], left[is_same], len(part_ends))
        other = ~is_same
        pairs, pair_times, pair_edge = _per_owner(owner[other], left[other] << _ID_BITS | right[other], len(part_ends))
        text, text_edge = self._group_text(a, b, a_ends, b_ends, a_at, b_at, a_done, b_done, ends, a_count + b_count)
        for i in range(len(part_ends)):
            s, p = slice(same_edge[i], same_edge[i + 1]), slice(pair_edge[i], pair_edge[i + 1])
            yield Part(len(a_lists[i]), len(b_lists[i]), int(group_edge[i + 1] - group_edge[i]),
                       int(link_edge[i + 1] - link_edge[i]), same[s], same_times[s], pairs[p], pair_times[p],
                       text[text_edge[i]:text_edge[i + 1] - 1])

    def _group_text(self, a, b, a_ends, b_ends, a_at, b_at, a_done, b_done, ends, item_edge) -> tuple[bytes, np.ndarray]:
        """Groups as text, each part's with a trailing semicolon, and where the parts' texts begin."""
        both = a_at & b_at
        group = np.cumsum(both, dtype=np.int32)
        before = np.concatenate([[0], ends])
        a_place = np.arange(len(a)) + b_done[before[group[a_ends] - both[a_ends]]]
        b_place = np.arange(len(b)) + a_done[ends[group[b_ends] - both[b_ends]]]
        (a_digits, a_lengths), (b_digits, b_lengths) = self.digits
        rows = np.zeros((len(a) + len(b), max(a_digits.shape[1], b_digits.shape[1]) + 1), np.uint8)
        rows[a_place, :a_digits.shape[1]] = a_digits[a]
        rows[b_place, :b_digits.shape[1]] = b_digits[b]
        rows[a_place, -1] = np.where(both[a_ends], ord("|"), ord(","))
        rows[b_place, -1] = np.where(both[b_ends], ord(";"), ord(","))
        lengths = np.zeros(len(rows), np.int64)
        lengths[a_place], lengths[b_place] = a_lengths[a] + 1, b_lengths[b] + 1
        written_to = np.concatenate([[0], np.cumsum(lengths)])
        flat = rows.reshape(-1)
        return flat[flat != 0].tobytes(), written_to[item_edge]


def _per_owner(owner: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each owner, how often each comes, and where each owner's begin."""
    found, times = np.unique(owner << (2 * _ID_BITS) | keys, return_counts=True)
    edge = np.searchsorted(found, np.arange(n + 1) << (2 * _ID_BITS))
    return found & (1 << 2 * _ID_BITS) - 1, times, edge


def aligned_texts(texts: list[str | None], aligner: Aligner) -> list[Part]:
    """One part for each text, empty if it is null, empty, or if joined tokens differ from it."""
    parts: list[list[Part | None]] = [[] for _ in texts]
    owners, stretches, held = [], [], 0

    def flush():
        for i, part in zip(owners, aligner.block(stretches)):
            parts[i].append(part)
        owners.clear(), stretches.clear()

    for i, text in enumerate(texts):
        for chunk in chunks_of(text) if text else ():
            if held and held + len(chunk) > BLOCK:
                flush()
                held = 0
            if owners and owners[-1] == i:
                stretches[-1].append(chunk)
            else:
                owners.append(i)
                stretches.append([chunk])
            held += len(chunk)
    if owners:
        flush()
    return [together(p) if p and None not in p else Part() for p in parts]


_ARRAYS = ("same", "same_times", "pairs", "pair_times")


def links(docs: DataFrame, a: Vocabulary, b: Vocabulary, keep_groups: bool = False) -> DataFrame:
    """Each row's counts, its distinct links with how often each comes, and the digest of its groups."""
    array = T.ArrayType(T.LongType())
    fields = [T.StructField("row", T.LongType()), docs.schema["doc_id"]]
    fields += [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    fields += [T.StructField("groups_sha256", T.StringType())] + [T.StructField(n, array) for n in _ARRAYS]
    fields += [T.StructField("groups", T.StringType())] * keep_groups
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = Aligner(a, b), TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = aligned_texts(batch.column("text").to_pylist(), aligner)
                columns = [pa.array(range(row, row + len(found)), pa.int64()), batch.column("doc_id")]
                columns += [pa.array([getattr(p, n) for p in found], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
                columns.append(pa.array([hashlib.sha256(p.groups).hexdigest() if p.n_a else "" for p in found], pa.string()))
                for n in _ARRAYS:
                    values = [getattr(p, n) for p in found]
                    edge = np.cumsum([0] + [len(v) for v in values])
                    columns.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate(values), pa.int64())))
                if keep_groups:
                    columns.append(pa.array([p.groups.decode() for p in found], pa.string()))
                row += len(found)
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _same_counts(rows: DataFrame, size: int) -> DataFrame:
    """(a, n): documents that link A's id to the B id of the same bytes, counted in a vector for each task."""
    schema = T._parse_datatype_string("a long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts[ids], pa.int64())], names=["a", "n"])

    return rows.select("same").mapInArrow(run, schema).groupBy("a").agg(F.sum("n").alias("n"))


def _vector(df: DataFrame, size: int) -> np.ndarray:
    """(a, n) as a vector; ``df`` has a row for each id of the vocabulary at most."""
    out, rows = np.zeros(size, np.int64), df.toPandas()
    out[rows["a"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def align(docs: DataFrame, a: Vocabulary, b: Vocabulary, keep_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A link is a pair of token occurrences that share a byte; an id pair's count
    is the number of rows that hold it linked. ``n_best`` counts the links
    whose count is the highest that their A id has in the corpus, ``count_sum``
    adds up the counts of all links. Groups read ``a1,a2|b1;a3|b2``; with
    ``keep_groups`` they are a column too.

    Null and empty texts, and texts that either tokenizer does not keep byte by
    byte, have no tokens: zeros and an empty digest. Every row counts for
    itself, repeated rows and rows with equal or null ids too. Other columns
    are ignored. An empty table gives no rows. Long texts are cut at blanks
    that no token crosses; memory is a block and a small multiple of the
    longest text.
    """
    size = len(a.tokens)
    rows = written(links(docs, a, b, keep_groups), "links")
    same = _same_counts(rows, size)
    exploded = rows.select("row", F.explode(F.arrays_zip("pairs", "pair_times")).alias("p")).select(
        "row", F.col("p.pairs").alias("pair"), F.col("p.pair_times").alias("times"))
    pairs = written(exploded.groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    a_of = F.shiftright("pair", _ID_BITS)
    best = _vector(same.union(pairs.select(a_of.alias("a"), "n")).groupBy("a").agg(F.max("n").alias("n")), size)
    counts = _vector(same, size)
    all_rows = pairs.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * FREQUENT >= F.lit(all_rows)  # FREQUENT pairs at most
    frequent = pairs.filter(often).orderBy("pair").toPandas()
    keys, key_counts = (frequent[c].to_numpy(np.int64) for c in ("pair", "n"))

    plain = [f for f in rows.schema.fields if f.name not in _ARRAYS]
    schema = T.StructType(plain + [T.StructField(n, T.LongType()) for n in ("n_best", "count_sum")])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in plain]

    def lookup(found: pa.ListArray, times: pa.ListArray, n: np.ndarray, is_best: np.ndarray) -> np.ndarray:
        edge = found.offsets.to_numpy().astype(np.int64)
        edge, times = edge - edge[0], times.flatten().to_numpy(zero_copy_only=False)
        sums = [np.concatenate([[0], np.cumsum(v)]) for v in (times * is_best, times * n)]
        return np.stack([s[edge[1:]] - s[edge[:-1]] for s in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("same").flatten().to_numpy(zero_copy_only=False)
            found = lookup(batch.column("same"), batch.column("same_times"), counts[ids], counts[ids] == best[ids])
            pair = batch.column("pairs").flatten().to_numpy(zero_copy_only=False)
            if len(keys):
                slot = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                n = np.where(keys[slot] == pair, key_counts[slot], 0)  # the others are joined
                found += lookup(batch.column("pairs"), batch.column("pair_times"), n, (n > 0) & (n == best[pair >> _ID_BITS]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(f, pa.int64()) for f in found], schema=arrow)

    rated = rows.mapInArrow(run, schema)
    spark = docs.sparkSession
    best_rows = spark.createDataFrame([(int(i), int(best[i])) for i in np.flatnonzero(best)], "a long, best long")
    known = spark.createDataFrame(pa.table({"pair": pa.array(keys, pa.int64())})) if len(keys) else None
    rest = exploded if known is None else exploded.join(F.broadcast(known), "pair", "left_anti")
    rare = (rest.join(pairs.filter(~often), "pair").withColumn("a", a_of).join(F.broadcast(best_rows), "a").groupBy("row")
            .agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"),
                 F.sum(F.col("n") * F.col("times")).alias("rare_sum")))
    out = rated.join(rare, "row", "left")
    out = (out.withColumn("n_best", F.col("n_best") + F.coalesce("rare_best", F.lit(0)))
           .withColumn("count_sum", F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
                      *["groups"] * keep_groups)


def pair_counts(docs: DataFrame, a: Vocabulary, b: Vocabulary) -> DataFrame:
    """(a, b, n): in how many rows each pair of ids is linked; edge cases as in ``align``."""
    rows = written(links(docs, a, b), "links")
    partner = Aligner(a, b).same.tolist()
    known = docs.sparkSession.createDataFrame([(i, p) for i, p in enumerate(partner) if p >= 0], "a long, b long")
    regular = _same_counts(rows, len(a.tokens)).join(F.broadcast(known), "a").select("a", "b", "n")
    pair = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    return regular.union(pair.select(F.shiftright("pair", _ID_BITS).alias("a"),
                                     F.col("pair").bitwiseAND(F.lit((1 << _ID_BITS) - 1)).alias("b"), "n"))
