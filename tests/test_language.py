"""Predictions against a plain computation, a model larger than its byte budget, and no row for a single trigram."""

import math
from collections import Counter

import pytest

from conftest import SF_SMALL
from reviewlens.operators import language
from reviewlens.plans.catalog import QUERIES

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog", "en"), (2, "Der schnelle braune Fuchs springt über den Hund", "de"),
    (3, "THE DOG and the fox are QUICK", "en"), (4, "Der Hund und der Fuchs sind schnell", "de"), (5, "el perro y el zorro 你好 \U0001F680", "es"),
    (6, None, "en"), (7, "", "en"), (8, "ab", "de"), (9, "the hound", None), (10, "über", None), (11, "zzzqqq", None),
]


def grams(text):
    t = (text or "").lower()
    return [t[i:i + 3] for i in range(len(t) - 2)]


def plain():
    counts = {}
    for _, text, lang in TEXTS:
        if lang:
            counts.setdefault(lang, Counter()).update(grams(text))
    v = len(set().union(*counts.values()))
    found = {}
    for seq, text, _ in TEXTS:
        g = grams(text)
        score = {k: sum(math.log(c[x] + 1) for x in g) - len(g) * math.log(c.total() + v) for k, c in counts.items()}
        found[seq] = min(score, key=lambda k: (-score[k], k)) if g else None
    return found


@pytest.mark.parametrize("max_bytes", [1 << 20, 40 * 8, 1])
def test_detect_equals_a_plain_computation(spark, max_bytes):
    df = spark.createDataFrame(TEXTS, "seq long, text string, lang string")
    found = language.detect(df, language.train_profile(df), ("seq",), max_bytes=max_bytes)
    assert found.columns == ["seq", "lang", "lang_pred"]
    rows = found.collect()
    assert {r.seq: r.lang_pred for r in rows} == plain() and len(rows) == len(TEXTS)
    assert {r.seq: r.lang for r in rows} == {seq: lang for seq, _, lang in TEXTS}


def test_a_model_beyond_the_budget_is_split_not_cut(spark):
    df = spark.createDataFrame(TEXTS, "seq long, text string, lang string")
    wide = language.train_profile(df).filter("gram <> -1").groupBy("gram").agg({"weight": "max"}).toDF("gram", "__w0")
    known, weights, rest = language._weights_sent(wide, 1, 16 * 20)
    left = {r.gram: r["__w0"] for r in rest.collect()}
    assert 0 < len(known) <= 20 and len(known) + len(left) == wide.count()
    assert weights.min() > max(left.values()) and not set(known) & set(left)


def test_repeated_and_null_keys_are_grouped(spark):
    df = spark.createDataFrame([(1, "the dog", "a"), (1, "the fox", "b"), (None, "der hund", "c"), (None, None, "c")],
                               "seq long, text string, note string")
    model = language.train_profile(spark.createDataFrame(TEXTS, "seq long, text string, lang string"))
    for max_bytes in (1 << 20, 40 * 8, 1):
        rows = language.detect(df, model, ("seq",), max_bytes=max_bytes).collect()
        assert {r.seq: r.lang_pred for r in rows} == {1: "en", None: "de"} and len(rows) == 2


def test_long_texts_go_in_blocks(monkeypatch):
    whole = [x for block in language.trigrams("abcdefgh") for x in block]
    monkeypatch.setattr(language, "BLOCK", 2)
    assert [x for block in language.trigrams("abcdefgh") for x in block] == whole and len(whole) == 6
    assert not list(language.trigrams(None)) and not list(language.trigrams("ab"))


def test_no_row_per_trigram_is_made_or_sorted(spark):
    for name in ("language_id", "ingest_quality_detected"):
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "gram" not in plan and "MapInArrow" in plan, name
