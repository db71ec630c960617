import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from reviewlens.session import get_session
    s = get_session("local[*]", "llm-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture
def odd_docs(spark):
    """Nulls everywhere, empty and blank texts, repeated rows, a text without blanks, and clashing columns."""
    rows = [
        (1, "alpha beta gamma delta epsilon", "en", "a", 30), (1, "alpha beta gamma delta epsilon", "en", "a", 30),
        (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \t\n ", "de", "b", 4), (None, "zeta eta theta", "en", "c", 14),
        (5, "x" * 5000, "fr", "c", 5000), (6, "1234 5678 !!! ???", None, "d", 17), (7, "Älpha ßeta 你好 мир", "de", "d", 16),
    ]
    names = ("fp", "score", "ids", "decoded", "key", "n", "label", "features", "row", "secrets", "range", "passage", "words")
    df = spark.createDataFrame(rows, DOCS)
    for n in names:
        df = df.selectExpr("*", f"'clash' AS {n}")
    return df


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
