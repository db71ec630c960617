"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.sources.shared import checkpointed, shared_folder  # noqa: F401 (operators take both from here)

BLOCK_BYTES = 1 << 20
ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_side(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` (narrow) rows.

    The rows are counted, so pass something checkpointed. Beyond the bound the
    join is left to a shuffle.
    """
    return F.broadcast(df) if df.count() <= rows else df


def row_key(df: DataFrame) -> Column:
    """A string that tells rows of ``df`` apart: two hashes of all columns. Only equal rows share it."""
    cells = [c for name in df.columns for c in (df[name].isNull(), df[name])]
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *cells)), 16, "0") for seed in (1, 2)])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_texts(df: DataFrame, added: list[tuple[str, T.DataType]],
              start: Callable[[], Callable[[list[str | None]], list[pa.Array]]],
              text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Replace ``text_col`` by the ``added`` columns, computed batch by batch.

    ``start`` runs once per task and returns the function that maps the texts
    of a batch to one Arrow array per added column. All other columns pass
    through unchanged, and the text itself if ``keep_text``. A column that is
    named like an added one gives way to it.
    """
    new = {n for n, _ in added}
    kept = [f for f in df.schema.fields if f.name not in new and (keep_text or f.name != text_col)]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in added])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):  # results leave in small batches
                batch = whole.slice(at, ROWS)
                arrays = compute(batch.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + arrays,
                                                 names=names + [n for n, _ in added])

    return df.mapInArrow(run, schema)


def word_blocks(text: str | None, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text, A-Z lower-cased, in lists.

    A list covers about ``size`` bytes, so a very long text is never held as
    one list of words. ``bytes.lower`` and ``bytes.split`` know ASCII only.
    """
    data = (text or "").encode().lower()
    if len(data) <= size:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].split()
        at = end


def word_lists(text: str | bytes | None, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text, unchanged, in lists that cover about ``size`` bytes each."""
    data = text if isinstance(text, bytes) else (text or "").encode()
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].split()
        at = end


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte behind its last."""
    codes = np.frombuffer(data, np.uint8)
    blank = np.ones(len(codes) + 2, bool)
    blank[1:-1] = (codes == 32) | ((codes >= 9) & (codes <= 13))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]
