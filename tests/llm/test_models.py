"""Quality, toxicity and language models: held-out accuracy and odd rows."""

import zlib

import numpy as np
import pytest

from reviewlens.llm import language as L
from reviewlens.llm import quality as Q
from reviewlens.llm import queries
from reviewlens.llm import toxicity as X

SF = "/root/testdata/sf0.01"


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_quality_held_out(spark, labels):
    rows = queries.op10_quality(spark, SF).collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id].quality for r in held]) >= 0.95


def test_attention_gradients_and_learning():
    """A bag is good exactly if one of its passages has a mark, which only attention can pick out."""
    rng = np.random.default_rng(1)
    bags, y = [], []
    for k in range(400):
        bag = rng.normal(0, 1, (rng.integers(1, 8), Q.WIDTH)).astype(np.float32)
        bag[:, 0] = 0
        if k % 2:
            bag[rng.integers(0, len(bag)), 0] = 4
        bags.append(bag)
        y.append(k % 2)
    model = Q.fit(bags[:300], y[:300])
    assert np.mean((model.score(bags[300:]) > 0.5) == np.array(y[300:], bool)) > 0.95


def test_quality_reads_whole_long_texts(monkeypatch):
    text = " ".join(f"word{k % 97}" for k in range(1000)) + "\nlast line. "
    whole = Q.encode(text, Q._WordIndex())
    monkeypatch.setattr(Q, "BLOCK_CHARS", 100)
    assert len(whole) == 20 and len(Q.encode(text, Q._WordIndex())) > 20
    assert Q.encode(None, Q._WordIndex()).shape == Q.encode(" \n", Q._WordIndex()).shape == (1, Q.WIDTH)


def test_quality_odd_rows(spark, odd_docs, no_docs):
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (99, 1)], "doc_id long, quality int")
    model = Q.train(odd_docs, marks)
    rows = Q.score(odd_docs.select("doc_id", "text", "fp", "score"), model).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[2] == by[3] == by[4]
    assert Q.keep_good(odd_docs, model, 0.0).columns == odd_docs.columns
    assert Q.keep_good(odd_docs, model, 0.0).count() == 9
    empty = Q.train(no_docs, marks)
    assert {r.score for r in Q.score(odd_docs.select("doc_id", "text"), empty).collect()} == {0.5}
    assert Q.score(no_docs, model).count() == 0


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op5_language(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.98


def test_language_counts_match_brute_force(spark):
    rows = [("en", "the cat. The dog"), ("en", "a"), ("fr", "été là!"), ("fr", None), (None, "the"), ("fr", "1 2 3")]
    got = {(r.lang, r.gram): r.n for r in L.gram_counts(spark.createDataFrame(rows, "lang string, text string")).collect()}
    want = {}
    for lang, text in rows:
        if lang and text:
            cleaned = "".join(c if c.isalpha() else " " for c in text.lower())
            for word in cleaned.split():
                padded = f" {word} "
                for n in L.SIZES:
                    for i in range(len(padded) - n + 1):
                        key = n
                        for c in padded[i:i + n]:
                            key = key << 21 | ord(c)
                        key = (key + (1 << 63)) % (1 << 64) - (1 << 63)
                        want[lang, key] = want.get((lang, key), 0) + 1
    assert got == want


def test_filter_has_no_false_negative_and_odd_rows(spark, odd_docs, no_docs):
    rows = [("en", "the quick brown fox"), ("de", "über der straße"), ("en", "again the fox")]
    model = L.train(spark.createDataFrame(rows, "lang string, text string"))
    keys, _, _ = L.gram_keys(["the quick brown fox"], L._letter_table())
    bit = np.uint64(1 << model.languages.index("en"))
    found = np.full(len(keys), ~np.uint64(0))
    for at in L.slots(keys):
        found &= model.filter[at]
    assert model.languages == ["en", "de"] and (found & bit).all()
    by = {r.doc_id: r for r in L.predict(odd_docs.select("doc_id", "text", "key"), model).collect()}
    assert by[2].lang_pred == by[3].lang_pred == by[4].lang_pred == by[6].lang_pred == "und" and by[2].score == 0
    assert by[7].lang_pred in model.languages and by[5].lang_pred in model.languages
    assert L.predict(no_docs, model).count() == 0
    nothing = L.train(no_docs.select("lang", "text"))
    assert {r.lang_pred for r in L.predict(odd_docs.select("doc_id", "text"), nothing).collect()} == {"und"}


def test_toxicity_finds_the_marked_words(spark, labels):
    rows = {r.doc_id: r for r in queries.op2_toxicity(spark, SF).collect()}
    assert len(rows) == 1000 and all(0 <= r.p_insult <= 1 and 0 <= r.p_toxic <= 1 for r in rows.values())
    known = [(rows[i], r.toxic) for i, r in labels.items()]
    clean = [r.toxic for r, y in known if y == 0]
    assert sum(clean) <= 0.01 * len(clean)
    texts = {r.doc_id: X.word_set(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    marked = {*queries.INSULTS, *queries.CONTEMPT}
    hits = [r.toxic for r, y in known if y == 1 and texts[r.doc_id] & marked]
    assert np.mean(hits) >= 0.9


def test_chain_uses_out_of_fold_probabilities():
    rng = np.random.default_rng(2)
    x = (rng.random((600, 5)) < 0.3).astype(float)
    first = x[:, 0] > 0
    second = first & (x[:, 1] > 0)
    y = np.column_stack([first, second]).astype(int)
    chain = X.fit_chain(x, y, np.arange(600), ["a", "b"], list("vwxyz"))
    p = chain.probabilities(x)
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1
    assert np.mean((p > 0.5) == y) > 0.97


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    chain = X.train(odd_docs, marks, ["toxic"])
    rows = X.predict(odd_docs.select("doc_id", "text", "label"), chain).collect()
    assert len(rows) == 9 and len({r.p_toxic for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert X.predict(no_docs, chain).count() == 0
    assert {r.p_toxic for r in X.predict(odd_docs, X.train(no_docs, marks, ["toxic"])).collect()} == {0.5}
