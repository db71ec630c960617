"""G1 text vectors and G2 dimension reduction with Spark ML.

G1: ``RegexTokenizer -> HashingTF -> IDF -> Normalizer`` gives a
deterministic, offline sentence vector (the IDF fit is one distributed
document-frequency aggregation). A pretrained model can be plugged in with
``embed_with`` (``mapInPandas``, model loaded once per task).

G2: vectors are L2-normalised (cosine becomes Euclidean) and projected on the
top ``k`` principal components; the covariance is a ``d x d`` distributed
aggregation, so the fit scales with the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUM_FEATURES = 1 << 14


def embed_text(df: DataFrame, text_col: str = "text", out: str = "vector",
               num_features: int = NUM_FEATURES) -> DataFrame:
    """G1: TF-IDF sentence vector with unit L2 norm (sparse ML vector)."""
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features),
        IDF(inputCol="__tf", outputCol="__idf"),
        Normalizer(inputCol="__idf", outputCol=out, p=2.0),
    ])
    return pipe.fit(df).transform(df).drop("__tok", "__tf", "__idf")


def embed_with(df: DataFrame, encode: Callable, dim: int, text_col: str = "text", key: str = "seq") -> DataFrame:
    """G1 hook: ``encode(list[str]) -> array (n, dim)`` applied per Arrow batch."""
    def run(batches):
        for pdf in batches:
            vecs = encode(pdf[text_col].fillna("").tolist())
            yield pdf[[key]].assign(embedding=[list(map(float, v)) for v in vecs])
    return df.select(key, text_col).mapInPandas(run, f"{key} long, embedding array<double>")


def reduce_dims(df: DataFrame, vec_col: str = "embedding", k: int = 5, out: str = "reduced") -> DataFrame:
    """L2-normalise, then project on the top ``k`` principal components."""
    if k < 1:
        raise ValueError("k must be >= 1")
    v = df.withColumn("__v", array_to_vector(F.col(vec_col).cast("array<double>")))
    v = Normalizer(inputCol="__v", outputCol="__n", p=2.0).transform(v)
    model = PCA(k=k, inputCol="__n", outputCol="__p").fit(v)
    return model.transform(v).withColumn(out, vector_to_array("__p")).drop("__v", "__n", "__p")


def sign_projection(vec: Column, size: int, masks: tuple[int, ...]) -> Column:
    """G2 without a fit: one coordinate per mask, the sum of the ``size`` entries of ``vec`` with fixed signs.

    Entry i counts negatively where i and the mask share an odd number of bits,
    so coordinates of different masks are orthogonal combinations.
    """
    def coordinate(mask: int) -> Column:
        total = None
        for i in range(size):
            x = F.get(vec, F.lit(i)).cast("double")
            x = -x if (i & mask).bit_count() % 2 else x
            total = x if total is None else total + x
        return total
    return F.array(*map(coordinate, masks))


def project_terms(df: DataFrame, keys: tuple[str, ...] = ("product", "seq"), text_col: str = "text", dims: int = 3,
                  out: str = "reduced", portable: bool = False) -> DataFrame:
    """G1 + G2 in one aggregation: TF-IDF over the whole vocabulary, unit length, projected by signs of a term's hash.

    Every term counts; none share a slot. Coordinate i takes its sign from bit i
    of the term's hash or, if ``portable``, from the i-th hexadecimal digit of
    its MD5, which any engine computes alike.
    One row per distinct ``keys``; a text without words, or null, lies at the origin.
    """
    if not 1 <= dims <= 32:
        raise ValueError("dims must be 1 to 32")
    n = df.select(*keys).distinct().count()
    terms = (df.select(*keys, F.explode(F.split(F.lower(text_col), r"\W+")).alias("term")).filter("term <> ''")
             .groupBy(*keys, "term").agg(F.count("*").alias("tf")))
    held = terms.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.col("tf") * F.log((F.lit(n) + 1) / (F.col("df") + 1))
    weighted = terms.join(held, "term").select(*keys, weight.alias("w"), (F.md5 if portable else F.xxhash64)("term").alias("h"))

    def sign(i: int) -> Column:
        if portable:
            return F.when(F.substring("h", i + 1, 1) >= "8", -1).otherwise(1)
        return 1 - 2 * F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1))

    sums = weighted.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"),
                                       *[F.sum(F.col("w") * sign(i)).alias(f"x{i}") for i in range(dims)])
    place = F.array(*[F.round(F.col(f"x{i}") / F.col("length"), 9) for i in range(dims)])
    placed = sums.select(*keys, F.when(F.col("length") > 0, place).alias(out))
    return df.select(*keys).distinct().join(placed, list(keys), "left").withColumn(
        out, F.coalesce(out, F.array(*[F.lit(0.0)] * dims)))
