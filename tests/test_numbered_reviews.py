import datetime

from pyspark.sql import functions as F

from reviewlens.operators import clusters, ids
from reviewlens.plans import catalog

TEXT = "the app is very good and it works well for all of my daily orders number {} call 9876543210 or me@mail.com"


def made(spark, folder):
    """Thirty documents, their events and the vectors of every third."""
    day = datetime.datetime(2024, 4, 20)
    for name, rows, schema in (
            ("documents", [(i, TEXT.format(i), "en", f"src{i % 3}") for i in range(30)], "doc_id long, text string, lang string, source string"),
            ("events", [(i, day, i, "view" if i % 2 else "click", i / 7) for i in range(30)],
             "event_id long, ts timestamp, user_id long, event_type string, value double"),
            ("embeddings", [(i, [float(i), 1.0], i % 4) for i in range(0, 30, 3)], "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_numbering_reads_the_tables_once(spark, tmp_path):
    """Doc ids need two passes over the clean reviews; the gate and its tables are passed once."""
    made(spark, tmp_path)
    read = [p for df in (catalog.members(spark, str(tmp_path)), catalog.normalized(spark, str(tmp_path)))
            for p in df.inputFiles() if "documents.parquet" in p]
    assert read == []


def test_numbered_reviews_are_the_clean_ones(spark, tmp_path):
    made(spark, tmp_path)
    whole = ids.with_doc_ids(catalog.clean(spark, str(tmp_path)))
    found = catalog.normalized(spark, str(tmp_path))
    assert sorted(whole.columns) == sorted(found.columns) and whole.count() > 10
    assert sorted(map(str, found.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    vectors = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    columns = ["product", "seq", "doc_id", "rating", "text", "thumbs_up", "app_version", "cluster_id", "embedding"]
    wanted = clusters.attach_vectors(whole, vectors, noise_labels=catalog.NOISE_SOURCE_LABELS).select(columns)
    got = catalog.members(spark, str(tmp_path)).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
    assert got.filter(F.col("text").contains("9876543210") | F.col("text").contains("me@mail.com")).isEmpty() and got.count() > 3
