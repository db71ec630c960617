import random

import pytest

from reviewlens.llm import decontaminate as D


def plain_score(a, b):
    best, table = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            step = D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH
            table[i][j] = max(0, table[i - 1][j - 1] + step, table[i - 1][j] - D.GAP, table[i][j - 1] - D.GAP)
            best = max(best, table[i][j])
    return best


def test_alignment_matches_the_plain_table():
    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(1, 14))] for _ in range(2))
        score, matched, start, end = D.align(a, b)
        assert score == plain_score(a, b) and 0 <= start <= end <= len(b) and matched <= min(len(a), len(b))


@pytest.fixture(scope="module")
def benchmark(spark):
    words = [f"item{i}w{j}" for i in range(4) for j in range(30)]
    rows = [(i, " ".join(words[30 * i:30 * i + 30])) for i in range(4)]
    return spark.createDataFrame(rows + [(7, "two words"), (8, ""), (9, None), (None, "no id but some words here")],
                                 "item_id long, text string")


def test_finds_exact_edited_and_hot_copies(spark, benchmark):
    rng = random.Random(3)
    items = {r.item_id: (r.text or "").split() for r in benchmark.collect()}
    filler = lambda n: [f"f{rng.randint(0, 300)}" for _ in range(n)]
    rows, want = [], set()
    for doc in range(60):
        item = items[doc % 4]
        kind = doc % 5
        if kind == 0:
            part = item
        elif kind == 1:
            part = [w if k % 6 else "other" for k, w in enumerate(item)]
        elif kind == 2:
            part = [w.upper() + "," for w in item[:10] + item[12:]]
        else:
            rows.append((doc, " ".join(filler(80) + item[:4] + filler(20))))
            continue
        want.add((doc, doc % 4))
        rows.append((doc, " ".join(filler(40) + part + filler(40))))
    rows += [(1000 + k, " ".join(items[3])) for k in range(300)]  # far more copies than a rare seed may have
    want |= {(1000 + k, 3) for k in range(300)}
    got = D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_one_frequent_seed_is_enough(spark):
    """Copies that share a single 3-gram are found however many documents, or other passages, hold it."""
    edited = "p1 p2 p3 x p5 p6 x p8 p9 x p11 p12 x p14 p15"
    rows = [(k, edited) for k in range(40)] + [(100 + k, f"y{k} p1 p2 p3 z{k}") for k in range(40)]
    rows += [(200 + k, f"u{k} red green blue v{k}") for k in range(40)]
    bench = spark.createDataFrame([(1, " ".join(f"p{k}" for k in range(1, 16))), (2, "red green blue")], "item_id long, text string")
    got = D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(k, 1) for k in range(40)} | {(200 + k, 2) for k in range(40)}


def test_rows_without_or_with_equal_ids_are_judged_one_by_one(spark):
    item = "alpha beta gamma delta epsilon"
    rows = [(None, item, "a"), (None, "clean words", "a"), (None, None, "a"), (5, item, "b"), (5, "other clean words", "b"), (6, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    left = D.remove_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns and sorted(map(tuple, left.collect()), key=str) == sorted(
        (r for r in rows if r[1] != item), key=str)


def test_long_texts_and_long_items(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 64)
    long_item = [f"q{k}" for k in range(900)]
    bench = spark.createDataFrame([(1, " ".join(long_item)), (2, "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10")], "item_id long, text string")
    noise = " ".join(f"n{k}" for k in range(3000))
    docs = spark.createDataFrame([(1, f"{noise} {' '.join(long_item[300:700])} {noise}"),
                                  (2, f"{noise}\n{noise} a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 {noise}"), (3, noise)],
                                 "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in D.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 2)} and got[2, 2] == 1.0


def test_table_against_brute_force(spark, docs, texts):
    """Every document that holds an item word for word, and no document without a long stretch of one."""
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r.item_id: [w for b in D._blocks(r.text) for w in b] for r in bench.collect()}
    words = {i: [w for b in D._blocks(t) for w in b] for i, t in texts.items()}
    exact = {(i, k) for i, w in words.items() for k, item in items.items()
             if f" {' '.join(item)} " in f" {' '.join(w)} "}
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(docs, bench).collect()}
    assert exact and exact <= set(got)
    for (i, k), r in got.items():
        assert plain_score(items[k], words[i]) / (D.MATCH * len(items[k])) == pytest.approx(r.score)


def test_odd_rows(spark, odd_docs, no_docs, benchmark):
    assert D.contaminated(odd_docs, benchmark).count() == 0
    assert D.contaminated(no_docs, benchmark).count() == 0
    assert D.contaminated(odd_docs, benchmark.limit(0)).count() == 0
    copy = spark.createDataFrame([(5, "alpha beta gamma delta epsilon"), (6, "alpha beta gamma delta epsilon")],
                                 "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(odd_docs, copy).collect()} == {(1, 5), (1, 6)}
    left = D.remove_contaminated(odd_docs, copy)
    assert left.columns == odd_docs.columns and left.count() == 7


def _pairs(spark, rows, bench, reach=40):
    items = D.items_of(bench).cache()
    found = D.passages(spark.createDataFrame(rows, "doc_id long, text string"), items, reach)
    return items, found.select("passage", "words", "seeds").dropDuplicates(["passage"]).cache()


def test_a_common_phrase_alone_pairs_nothing(spark):
    rows = [(k, f"a{k} b{k} c{k} d{k} one of the e{k} f{k} g{k} h{k} i{k}") for k in range(300)]
    bench = spark.createDataFrame([(k, f"q{k} r{k} s{k} t{k} one of the u{k} v{k} w{k} x{k} y{k}") for k in range(300)],
                                  "item_id long, text string")
    items, texts = _pairs(spark, rows, bench)
    assert texts.count() == 300 and D.candidates(texts, items).count() < 1000


def test_candidates_lose_no_pair_with_enough_words(spark, monkeypatch):
    """Against all pairs: whoever shares an n-gram and enough words is a candidate, by rare and by frequent n-grams."""
    rng = random.Random(11)
    word = lambda: f"w{int(rng.expovariate(0.12))}"
    rows = [(k, " ".join(word() for _ in range(rng.randint(1, 40)))) for k in range(150)]
    bench = spark.createDataFrame([(k, " ".join(word() for _ in range(rng.randint(3, 14)))) for k in range(60)], "item_id long, text string")
    for rare in (0, 3, 16):
        monkeypatch.setattr(D, "RARE", rare)
        items, texts = _pairs(spark, rows, bench)
        want = {(t.passage, i.item_id) for t in texts.collect() for i in items.collect()
                if {s.seed for s in i.seeds} & set(t.seeds)
                and sum(w in set(t.words.split(" ")) for w in i.words) >= max(0.5 * len(i.words), min(8, len(i.words)))}
        got = {(r.passage, r.item_id) for r in D.candidates(texts, items).collect()}
        assert len(want) > 20 and want <= got


def test_edited_copies_against_all_pairs(spark):
    """Recall of edited copies that a full alignment of every pair reports; exact copies are all found."""
    rng = random.Random(2)
    items = {k: [f"v{rng.randint(0, 400)}" for _ in range(rng.randint(8, 30))] for k in range(40)}
    rows = []
    for doc in range(200):
        copy = [w for w in items[doc % 40] if rng.random() > 0.1 * (doc % 4)]
        copy = [w if rng.random() > 0.08 * (doc % 4) else f"v{rng.randint(0, 400)}" for w in copy]
        pad = lambda: [f"v{rng.randint(0, 400)}" for _ in range(10)]
        rows.append((doc, pad() + copy + pad()))
    want = set()
    for doc, words in rows:
        for k, item in items.items():
            if sum(map(set(words).__contains__, item)) * 2 >= len(item):
                score, matched, _, _ = D.align(item, words)
                if score >= D.MIN_SCORE * D.MATCH * len(item) and matched >= min(D.MIN_MATCHED, len(item)):
                    want.add((doc, k))
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and {(d, d % 40) for d in range(0, 200, 4)} <= got


def test_very_long_dense_text_becomes_bounded_passages(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "in the end of")], "item_id long, text string")
    text = "in the end of x " * 20_000 + "alpha beta gamma delta epsilon zeta eta theta " + "in the end of y " * 20_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    reach = 10
    items = D.items_of(bench).cache()
    assert max(len(r.words.split(" ")) for r in D.passages(docs, items, reach).collect()) <= 4 * reach + D.SEED_WORDS
    assert {r.item_id: r.score for r in D.contaminated(docs, bench).collect()} == {1: 1.0, 2: 1.0}
