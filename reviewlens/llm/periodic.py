"""Periodic runs of words by seeds and diagonals.

A run is a stretch of words with smallest period q that repeats at least
``min_exponent`` times, is at least ``min_length`` words long and cannot be
extended. At lag q its words match over ``max(min_length - q, (min_exponent -
1) q)`` places at least: the guaranteed overlap. Lags are dealt into classes
whose k-grams are no longer than that overlap and no shorter than the longest
lag of the class. Each class indexes its k-grams by hash and enumerates pairs
of occurrences in the same document. Next occurrences suffice: if a k-gram of
a run came again before q words, the run would have a smaller period, as k is
at least q. So a text of one repeated word has no more pairs than words.

A pair is a seed on the diagonal of its lag. It is extended both ways word by
word, and a table of the furthest place covered on each lag suppresses seeds
that an earlier extension holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reviewlens.llm.common import ROWS, word_lists

MEMO = 500_000
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # odd constants that spread bits, chosen once


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[0]
    return x ^ (x >> np.uint64(29))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of two grams, one behind the other, as one; not linear, so no text has systematic collisions."""
    return _mixed(_mixed(left) * _ODD[1] + right)


def lag_classes(n: int, min_length: int, min_exponent: int) -> Iterator[tuple[int, int, int]]:
    """(shortest lag, longest lag, gram length) of every class that ``n`` words can hold a run of."""
    low, high = 1, min_length // min_exponent
    gram = min_length - high
    while low <= n // min_exponent:
        if high >= low:
            yield low, min(high, n // min_exponent), gram
        low = max(high + 1, low)
        gram = high = (min_exponent - 1) * low


def _seeds(keys: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Lags and places of grams whose next occurrence is ``low`` to ``high`` words on, by lag and place."""
    ranked = np.sort(keys)
    if not (ranked[1:] == ranked[:-1]).any():
        return keys[:0], keys[:0]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    at = order[same]
    lag = order[same + 1] - at
    fits = (lag >= low) & (lag <= high)
    at, lag = at[fits], lag[fits]
    order = np.lexsort((at, lag))
    return lag[order], at[order]


def _forward(ids: np.ndarray, at: int, lag: int) -> int:
    """The first place from ``at`` on whose word differs from the one ``lag`` on."""
    end, step = len(ids) - lag, 64
    while at < end:
        stop = min(at + step, end)
        differs = ids[at:stop] != ids[at + lag:stop + lag]
        if differs.any():
            return at + int(differs.argmax())
        at, step = stop, min(2 * step, 1 << 16)
    return end


def _backward(ids: np.ndarray, at: int, lag: int) -> int:
    """The first place of the matching stretch that ends before ``at``."""
    step = 64
    while at > 0:
        stop = max(at - step, 0)
        differs = (ids[stop:at] != ids[stop + lag:at + lag])[::-1]
        if differs.any():
            return at - int(differs.argmax())
        at, step = stop, min(2 * step, 1 << 16)
    return 0


def runs_of(ids: np.ndarray, min_length: int = 24, min_exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the word numbers ``ids``, by start, then period."""
    found, size, grams = [], 1, _mixed(ids.astype(np.uint64) + _ODD[1])
    for low, high, gram in lag_classes(len(ids), min_length, min_exponent):
        if len(ids) < gram + low:
            break
        while 2 * size <= gram:
            grams, size = _joined(grams[:-size], grams[size:]), 2 * size
        keys = _joined(grams[:len(ids) - gram + 1], grams[gram - size:])
        covered: dict[int, int] = {}
        lags, places = _seeds(keys, low, high)
        if not len(lags):
            continue
        new = np.ones(len(lags), bool)  # a seed right behind another on its diagonal lies in the same stretch
        new[1:] = (lags[1:] != lags[:-1]) | (places[1:] != places[:-1] + 1)
        for lag, at in zip(lags[new].tolist(), places[new].tolist()):
            if covered.get(lag, -1) > at:
                continue
            start, end = _backward(ids, at, lag), _forward(ids, at, lag)
            covered[lag] = end
            length = end - start + lag
            if length >= max(min_length, min_exponent * lag):
                found.append((start, length, lag))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay if every run keeps its first period only."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) == 0


class _Numbers(dict):
    """Word -> number, and the words in that order."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.words.append(word)
        return number


def find_runs(docs: DataFrame, min_length: int = 24, min_exponent: int = 3,
              arrange: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row.

    ``runs`` holds (start, length, period) in words, by start, then period;
    ``collapsed`` is the text's words joined by one blank, each run cut down to
    its first period. ``arrange(doc_id, n)`` may give, for a text of n words,
    which word stands at each place instead of the text's own order.

    Null, empty and blank texts have no words, no runs and an empty
    ``collapsed``. Every row is judged by itself, so repeated rows, equal and
    null ids do not matter, and no rows are moved. Other columns are ignored. An
    empty table gives no rows. Memory is a small multiple of the longest text.
    """
    if min_exponent < 3:
        raise ValueError("a k-gram within the guaranteed overlap must be as long as its lag: min_exponent is 3 or more")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    arrow = to_arrow_schema(schema)

    def judge(doc_id, text: str | None, numbers: _Numbers) -> tuple[int, list, str]:
        parts = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in word_lists(text)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        order = arrange(doc_id, len(ids)) if arrange is not None and len(ids) else None
        if order is not None:
            ids = ids[order]
        runs = runs_of(ids, min_length, min_exponent)
        if order is None and not runs:
            return len(ids), runs, b" ".join(b" ".join(words) for words in word_lists(text) if words).decode()
        kept = kept_words(len(ids), runs)
        return len(ids), runs, b" ".join(map(numbers.words.__getitem__, ids[kept].tolist())).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch, out = whole.slice(at, ROWS), []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    out.append(judge(doc_id, text, numbers))
                    if len(numbers) > MEMO:
                        numbers = _Numbers()
                n, runs, collapsed = zip(*out)
                runs = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs]
                yield pa.RecordBatch.from_arrays([batch.column(0)] + [
                    pa.array(c, f.type) for c, f in zip((n, runs, collapsed), list(arrow)[1:])], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
