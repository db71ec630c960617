"""Landing-file scans and output sinks (A1 re-aimed, A6-A12, B11).

Every write is a Spark write (no driver-side file handling): JSON Lines or
Parquet, partitioned by product and week so a re-run replaces exactly its own
partitions (dynamic partition overwrite) and readers prune to one week.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.operators.ids import with_doc_ids
from reviewlens.schemas import NORMALIZED_REVIEW, RAW_RECORD

REVIEW_FIELDS = ["review_id", "author", "rating", "text", "timestamp", "thumbs_up", "app_version"]


def read_raw_records(spark: SparkSession, path: str) -> DataFrame:
    """A1 landing scan: store records as JSON Lines, fixed schema (no inference)."""
    return spark.read.schema(RAW_RECORD).json(path)


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, value): the objects of JSON arrays as JSON text, numbered by position in their file.

    Files are read in splits, at every ``}``. An object begins where ``,``,
    ``{`` and a quoted name follow a ``}``: inside a string that quote would
    end the string, and no name could follow it. Names must be letters,
    digits and ``_``. Objects may hold objects, but no array of objects.
    Numbers come from counts per split, so no task sees a whole file; an
    object that crosses splits is put together again. A file that does not
    begin as an array of objects has none.
    """
    parts = spark.read.option("lineSep", "}").text(path).select(
        "value", F.monotonically_increasing_id().alias("at"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    split = Window.partitionBy("file", "block").orderBy("at")
    first = (F.col("block") == 0) & (F.row_number().over(split) == 1) & F.col("value").rlike(r"^\s*\[\s*\{")
    opens = first | F.col("value").rlike(r'^\s*,\s*\{\s*"[A-Za-z_][A-Za-z0-9_]*"\s*:')
    marked = parts.withColumn("opens", opens.cast("long")).withColumn("nth", F.sum("opens").over(split))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy("file", "block").agg(F.sum("opens").alias("n"))  # a row per split
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn(
        "total", F.sum("n").over(Window.partitionBy("file")))
    numbered = marked.join(counts, ["file", "block"]).withColumn("seq", F.col("before") + F.col("nth") - 1)
    whole = numbered.filter("seq >= 0").groupBy("file", "seq").agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("pieces"))
    body = F.regexp_replace(F.array_join(F.col("pieces.value"), "}"), r"^\s*[\[,]\s*", "")
    last = F.col("seq") == F.col("total") - 1
    return whole.select("file", "seq", F.when(last, F.regexp_replace(body, r"\s*\]\s*$", "")).otherwise(
        F.concat(body, F.lit("}"))).alias("value"))


def read_normalized(spark: SparkSession, path: str, product: str = "default") -> DataFrame:
    """Normalised review files (JSON arrays of flat objects); rating and text required,
    thumbs_up defaults to 0, app_version to null; doc ids by position (C5).

    Read in splits by ``array_records``. A missing file is an error; a file
    that is no JSON array has no reviews, one that breaks off has those
    before the break. Several files follow each other by path.
    """
    df = (array_records(spark, path).select("file", "seq", F.from_json("value", NORMALIZED_REVIEW).alias("r"))
          .select(F.lit(product).alias("product"), "file", "seq", "r.*")
          .filter(F.col("rating").isNotNull() & F.col("text").isNotNull())
          .withColumn("thumbs_up", F.coalesce(F.col("thumbs_up"), F.lit(0))))
    ends = df.groupBy("file").agg((F.max("seq") + 1).alias("__n"))  # a row per file
    start = F.sum("__n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    starts = ends.select("file", F.coalesce(start, F.lit(0)).alias("__start"))
    return with_doc_ids(df.join(starts, "file").withColumn("seq", F.col("seq") + F.col("__start")).drop("file", "__start"))


def _overwrite_partitions(df: DataFrame, fmt: str, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(fmt).save(path)


def write_if_any(df: DataFrame, write: Callable[..., None], *args, **kwargs) -> bool:
    """``write(df, ...)`` unless ``df`` is empty; an empty run writes and replaces nothing. True if written."""
    if df.isEmpty():
        return False
    write(df, *args, **kwargs)
    return True


def write_reviews(df: DataFrame, path: str, by=("product", "iso_week"), fmt: str = "json") -> None:
    """All seven review fields per run partition."""
    _overwrite_partitions(df.select(*by, *REVIEW_FIELDS), fmt, path, list(by))


def write_anonymised(df: DataFrame, path: str, by=("product", "iso_week"), fmt: str = "json") -> None:
    """A8 + C4: review_id, author and timestamp dropped."""
    keep = [c for c in REVIEW_FIELDS if c not in ("review_id", "author", "timestamp")]
    _overwrite_partitions(df.select(*by, *keep), fmt, path, list(by))


def write_themes(themes: DataFrame, path: str, by=("product", "iso_week")) -> None:
    """Themes of a run, replacing that run's partition only."""
    _overwrite_partitions(themes, "json", path, list(by))


def write_payload(payload: DataFrame, path: str, by=("product", "iso_week")) -> None:
    """A10: one dashboard row per run, written once and read by partition."""
    _overwrite_partitions(payload, "json", path, list(by))


def read_payload(spark: SparkSession, path: str, product: str, iso_week: str, schema: T.StructType) -> DataFrame:
    """Payload of one run, with the ``schema`` that was written; the filter prunes to one partition."""
    return spark.read.schema(schema).json(path).filter((F.col("product") == product) & (F.col("iso_week") == iso_week))


def export_json(df: DataFrame, path: str) -> None:
    """Every row as one JSON text line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
