"""Keyword search by index (B9): trigram postings beside a stored copy of the reviews.

A scan lower-cases every text for every search. Here the three-character
pieces of text and author are posted once; a search looks up its rarest
pieces and reads only the parts of the stored reviews that hold candidates,
then tests them with the plain predicate, so its result is that of the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.operators.explore import filters

GRAM = 3
PARTS = 256        # folders of postings, and of reviews: what a search can leave unread
RAREST = 3         # pieces of a term whose postings are met
BLOCK = 1 << 16    # characters of a text whose pieces are listed at once


def _part(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(PARTS)).cast("int")


def grams_of(text: Column) -> Column:
    """Distinct trigrams of a text; a text of one or two characters is its own piece."""
    long = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
    return F.when(F.char_length(text) >= GRAM, long).when(F.char_length(text) > 0, F.array(text))


def postings(reviews: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(gram, *key) of the lower-cased text and author; long texts in blocks that overlap by two characters."""
    fields = reviews.select(*key, F.explode(F.array("text", "author")).alias("field")).filter("field is not null")
    last = F.floor((F.greatest(F.char_length("low"), F.lit(1)) - 1) / BLOCK).cast("int")
    blocks = fields.select(*key, F.lower("field").alias("low")).select(
        *key, "low", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    piece = F.substring(F.col("low"), F.col("block") * BLOCK + 1, F.lit(BLOCK + GRAM - 1))
    return blocks.select(*key, F.explode(grams_of(piece)).alias("gram")).distinct().select("gram", *key)


def build(reviews: DataFrame, path: str, key: tuple[str, ...] = ("product", "seq")) -> None:
    """Write ``reviews`` (``key`` tells them apart) and their postings below ``path``.

    Postings are cut into ranges of (folder, gram, key), so a gram that a third
    of the reviews hold is spread over many tasks and files. Reviews lie in
    folders by hash of their key.
    """
    home = reviews.withColumn("__part", _part(*key))
    home.repartition("__part", *key).write.partitionBy("__part").parquet(f"{path}/reviews")
    posts = postings(reviews, key).withColumn("__part", _part(*key)).withColumn("__folder", _part("gram"))
    (posts.repartitionByRange("__folder", "gram", *key).sortWithinPartitions("__folder", "gram")
     .write.partitionBy("__folder").parquet(f"{path}/postings"))


def _candidates(posts: DataFrame, term: str, key: tuple[str, ...]) -> DataFrame | None:
    """Keys that hold the term's rarest grams; None if some gram is in no review.

    A term of one or two characters is part of a gram of every text that
    holds it: all postings are read then, but no text.
    """
    if len(term) < GRAM:
        return posts.filter(F.col("gram").contains(term)).select(*key, "__part").distinct()
    grams = sorted({term[i:i + GRAM] for i in range(len(term) - GRAM + 1)})
    wanted = posts.sparkSession.createDataFrame([(g,) for g in grams], "gram string")
    folders = sorted({r[0] for r in wanted.select(_part("gram")).collect()})
    near = posts.filter(F.col("__folder").isin(folders) & F.col("gram").isin(grams))
    count = {r.gram: r.n for r in near.groupBy("gram").agg(F.count("*").alias("n")).collect()}  # a row per gram of the term
    if len(count) < len(grams):
        return None
    rare = sorted(grams, key=lambda g: (count[g], g))[:RAREST]
    return (near.filter(F.col("gram").isin(rare)).groupBy(*key, "__part").agg(F.count("*").alias("n"))
            .filter(F.col("n") == len(rare)).drop("n"))


def search(spark: SparkSession, path: str, term: str, key: tuple[str, ...] = ("product", "seq")) -> DataFrame:
    """The stored reviews that ``explore.filters(search=term)`` keeps.

    A blank term keeps all, as there. Folders without a candidate are not
    read; their list has ``PARTS`` entries at most.
    """
    reviews, posts = spark.read.parquet(f"{path}/reviews"), spark.read.parquet(f"{path}/postings")
    if not term.strip():
        return reviews.drop("__part")
    found = _candidates(posts, term.lower(), key)
    if found is None:
        return reviews.drop("__part").limit(0)
    parts = sorted(r[0] for r in found.select("__part").distinct().collect())
    held = reviews.filter(F.col("__part").isin(parts)).join(found, ["__part", *key], "left_semi")
    return held.filter(filters(search=term)).drop("__part")
