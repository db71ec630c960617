"""Document fingerprints and language-model scores against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import fingerprints as P
from reviewlens.llm import lm_score as M


def plain_report(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    memo, out = P._WordHashes(), []
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]
        own, other, then = (P.fingerprint(t, memo) for t in (text, edited, following))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{own:032x}", f"{other:032x}",
                    P.likeness(own, other), P.likeness(own, then)))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.parametrize("ranges", [None, 1, 7])
def test_report_matches_brute_force(docs, texts, ranges):
    got = P.with_next(docs, ranges).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain_report(list(texts.items()))


def test_counts_and_radius_search_match_brute_force(docs, texts):
    rows = P.fingerprint_report(docs, every=10, radius=12, blocks=14).collect()
    values = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    for r in rows:
        near = sum((values[r.doc_id] ^ v).bit_count() <= 12 for v in values.values()) - 1
        assert r.n_near == (near if r.doc_id % 10 == 0 else None)


def test_tables_hold_every_pair_within_the_radius(spark):
    base = (1 << 127) | 0x1234567890ABCDEF
    values = [base ^ sum(1 << (k * 29 + j * 31) % 128 for j in range(n)) for k in range(6) for n in range(8)]
    frame = spark.createDataFrame([(f"{v:032x}",) for v in values] + [(None,)], "fingerprint string")
    got = {(r.query, r.fingerprint): r.distance for r in P.search(frame, frame, radius=4).collect()}
    want = {(f"{a:032x}", f"{b:032x}"): (a ^ b).bit_count() for a in values for b in values if (a ^ b).bit_count() <= 4}
    assert got == want and len(P.block_tables(4, 6)) == 15


def test_search_drops_rows_that_meet_no_query(spark):
    """Few queries in a large index: the bit table lets little through, all that is near is found."""
    index = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 256).substr(1, 32).alias("fingerprint"))
    values = [int(r[0], 16) for r in index.collect()]
    asked = [values[5] ^ 0b1011, values[7] ^ (0b11 << 100) ^ 0b11, values[9] ^ 0b11111]
    queries = spark.createDataFrame([(f"{v:032x}",) for v in asked], "fingerprint string")
    got = {(int(r.query, 16), int(r.fingerprint, 16), r.distance) for r in P.search(index, queries).collect()}
    assert got == {(a, v, (a ^ v).bit_count()) for a in asked for v in values if (a ^ v).bit_count() <= 4}
    assert len(got) == 2
    keys = spark.range(1000).select(F.xxhash64("id").alias("key"))
    table, size = P._present(keys)
    word, bit = P._place(size)
    kept = spark.range(100_000).select("id", F.xxhash64("id").alias("key")).withColumn("word", F.expr(word)).join(table, "word") \
        .filter(F.expr(f"shiftrightunsigned(bits, {bit}) & 1 = 1"))
    assert kept.filter("id < 1000").count() == 1000 and kept.count() < 15_000


def test_long_texts_in_blocks(monkeypatch):
    from reviewlens.llm import common
    text = " ".join(f"w{k % 50}" for k in range(500))
    whole = P.fingerprint(text, P._WordHashes())
    monkeypatch.setattr(P, "word_blocks", lambda t: common.word_blocks(t, 37))
    assert P.fingerprint(text, P._WordHashes()) == whole


def test_odd_rows_of_fingerprints(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = P.with_next(odd_docs).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain_report(rows)
    report = {r.doc_id: r for r in P.fingerprint_report(odd_docs, every=2).collect()}
    assert report[2].n_near == 2 and report[1].n_near is None and report[2].fingerprint == "0" * 32
    assert P.fingerprint_report(no_docs).count() == 0
    single = odd_docs.filter("doc_id = 7")
    assert P.with_next(single).first().near_next == 1.0


def plain_scores(texts):
    split = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) if w]
             for i, t in texts.items()}
    words = Counter(w for ws in split.values() for w in ws)
    own = {i: Counter(zip(ws, ws[1:])) for i, ws in split.items()}
    pairs = sum(own.values(), Counter())
    total, out = sum(words.values()), {}
    for i, ws in split.items():
        v = math.log(words[ws[0]] / total) if ws else 0.0
        for (a, b), c in own[i].items():
            v += c * (math.log((pairs[a, b] - c) / words[a]) if pairs[a, b] > c else math.log(M.ALPHA * words[b] / total))
        out[i] = (len(ws), v)
    return out


@pytest.mark.parametrize("hot_bits,sample", [(16, 16), (3, 1), (20, 10**9)])
def test_scores_match_brute_force(docs, texts, monkeypatch, hot_bits, sample):
    """Whichever bigrams are kept from the shuffle, the scores are the same."""
    monkeypatch.setattr(M, "HOT_BITS", hot_bits)
    monkeypatch.setattr(M, "SAMPLE", sample)
    got = {r.doc_id: (r.n_tokens, r.log_score) for r in M.score(docs).collect()}
    want = plain_scores(texts)
    assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items()}
    assert all(got[i][1] == pytest.approx(v, abs=1e-6) for i, (_, v) in want.items())


def test_rare_words_are_one_unknown_word(spark, monkeypatch):
    monkeypatch.setattr(M, "VOCABULARY_BITS", 2)
    rows = [(1, "a a a a a a b c"), (2, "a b"), (3, "a c")]
    got = {r.doc_id: r.log_score for r in M.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    unknown = {i: " ".join(w if w == "a" else "?" for w in t.split()) for i, t in rows}
    assert all(got[i] == pytest.approx(v) for i, (_, v) in plain_scores(unknown).items())


@pytest.mark.parametrize("common_bits", [0, 3, 6])
def test_rare_words_keep_their_own_counts(spark, docs, texts, monkeypatch, common_bits):
    """However few words are common, the others count as themselves; many documents open with or consist of rare ones."""
    monkeypatch.setattr(M, "COMMON_BITS", common_bits)
    rows = [(1, "a a a a a a b c"), (2, "a b"), (3, "a c"), (4, "c b c b"), (5, "d"), (None, "b c")]
    got = {r.doc_id: (r.n_tokens, r.log_score) for r in M.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_scores(dict(rows))
    assert got.keys() == want.keys() and all(got[i] == (n, pytest.approx(v)) for i, (n, v) in want.items())
    got = {r.doc_id: r.log_score for r in M.score(docs).collect()}
    assert all(got[i] == pytest.approx(v, abs=1e-6) for i, (_, v) in plain_scores(texts).items())


def test_rare_words_of_a_large_table_are_not_merged(spark):
    """Two words seen once among more than 2^20 tokens have one count each."""
    rows = [(1, "x y"), (2, "x z"), (3, "a " * (1 << 20))]
    got = {r.doc_id: r.log_score for r in M.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == pytest.approx(v) for i, (_, v) in plain_scores(dict(rows)).items())


def test_long_texts_cross_blocks(spark, monkeypatch):
    from reviewlens.llm import common
    rows = [(1, "x y z " * 40), (2, "x y"), (3, "z x")]
    whole = {r.doc_id: r.log_score for r in M.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    monkeypatch.setattr(M, "word_blocks", lambda t: common.word_blocks(t, 11))
    parts = {r.doc_id: r.log_score for r in M.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert parts == pytest.approx(whole) and whole[1] == pytest.approx(plain_scores(dict(rows))[1][1])


def test_odd_rows_of_scores(odd_docs, no_docs):
    by = {r.doc_id: r for r in M.score(odd_docs).collect()}
    assert by[2].n_tokens == 0 and by[2].log_score == 0 and by[2].mean_score is None and by[1].n_tokens == 10
    assert len(by) == 8 and by[None].n_tokens == 3
    assert M.score(no_docs).count() == 0


def test_bigrams_move_in_packed_rows(spark):
    """A chunk sends a few bytes for each of its documents' bigrams, not a row; frequent, rare and long ones alike."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(("a", f"w{rng.randrange(300)}", f"r{i}x{k}")) for k in range(rng.randrange(300)))) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    sent = M._requests(table, M.vocabulary(table))
    n, size = sent.selectExpr("count(*)", "sum(length(keys) + length(others) + length(held) + length(rows) + length(times))").first()
    pairs = sum(len(set(zip(t.split(), t.split()[1:]))) for _, t in rows)
    assert n <= 2 * (1 + 3 * 2 ** M.BUCKET_BITS) and n * 10 < pairs and size < 20 * pairs


@pytest.mark.parametrize("words,rows,held", [(50, 1 << 14, 1), (1 << 21, 3, 10)])
def test_chunks_and_handed_scores_of_any_size(spark, docs, texts, monkeypatch, words, rows, held):
    for name, value in (("CHUNK_WORDS", words), ("CHUNK_ROWS", rows), ("HELD", held), ("COMMON_BITS", 5)):
        monkeypatch.setattr(M, name, value)
    got = {r.doc_id: r.log_score for r in M.score(docs).collect()}
    assert all(got[i] == pytest.approx(v, abs=1e-6) for i, (_, v) in plain_scores(texts).items())


def test_packed_numbers():
    for x in ([0], [0, 255, 256], [1 << 63, 5], list(range(70_000))):
        assert M.unpacked(M.packed(np.array(x, np.uint64))).tolist() == x
    keys = np.random.default_rng(1).integers(0, 1 << M._KEY_BITS, 1000)
    assert M._gathered(M._spread(keys)).tolist() == keys.tolist()
