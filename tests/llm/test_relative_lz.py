import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from reviewlens.llm import queries, relative_lz
from tests.llm.conftest import SF


def brute(texts, window):
    """Kept words of each text, by counting every window of every text."""
    lists = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for words in lists:
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append([w for i, w in enumerate(words) if i not in gone])
    return out


def brute_longest(text):
    n = len(text)
    def common(a, b):
        k = 0
        while max(a, b) + k < n and text[a + k] == text[b + k]:
            k += 1
        return k
    return [max((common(a, b) for b in range(n) if b != a), default=0) for a in range(n)]


def random_texts(rng, n, vocabulary, longest=150):
    words = [f"w{i}" for i in range(vocabulary)]
    texts = [[rng.choice(words) for _ in range(rng.randrange(longest))] for _ in range(n)]
    for _ in range(n):
        a, b = rng.choice(texts), rng.choice(texts)
        at = rng.randrange(len(a) + 1)
        b[rng.randrange(len(b) + 1):0] = a[at:at + rng.randrange(60)]
    return [" ".join(t) for t in texts]


def test_longest_matches_against_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        phrases = [[rng.choice("abc") for _ in range(rng.randrange(1, 30))] for _ in range(rng.randrange(1, 8))]
        text = [x for i, p in enumerate(phrases) for x in [*map(ord, p), -1 - i]]
        assert relative_lz.longest_matches(np.array(text), 31).tolist() == brute_longest(text)


def test_windows_across_factor_borders_are_found():
    a, b = [f"a{i}".encode() for i in range(12)], [f"b{i}".encode() for i in range(12)]
    phrases = [a[:6] + b[:8], [b"x"] + a[2:6] + b[:4] + [b"y"], a[:4] + [b"z"] + b[2:12]]
    masks = relative_lz.duplicate_windows(phrases, 8).tolist()
    for words, mask in zip(phrases, masks):
        for i in range(len(words) - 7):
            found = sum(p[j:j + 8] == words[i:i + 8] for p in phrases for j in range(len(p) - 7))
            assert (mask >> i & 1) == (found > 1)


@pytest.mark.parametrize("window", [5, 12, 35])
@pytest.mark.parametrize("crowd,block", [(2000, 1 << 19), (3, 200), (1, 1)])
def test_random_texts_against_brute_force(spark, monkeypatch, window, crowd, block):
    monkeypatch.setattr(relative_lz, "CROWD", crowd)
    monkeypatch.setattr(relative_lz, "BLOCK_WORDS", block)
    rng = random.Random(window)
    texts = random_texts(rng, 60, 4, 60) + random_texts(rng, 60, 500) + ["w1 " * 200, "w1 " * 90, "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in relative_lz.remove_duplicates(rows, window).collect()}
    expected = {i: b" ".join(w).decode() for i, w in enumerate(brute(texts, window))}
    assert got == expected


def test_text_cut_into_stretches(spark, monkeypatch):
    monkeypatch.setattr(relative_lz, "STRETCH", 50)
    texts = random_texts(random.Random(3), 80, 300, 400)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in relative_lz.remove_duplicates(rows).collect()}
    assert got == {i: b" ".join(w).decode() for i, w in enumerate(brute(texts, 35))}


def test_query_against_brute_force(spark, texts):
    got = {r.doc_id: r for r in queries.op13_substring_dedup(spark, SF).collect()}
    assert set(got) == set(texts)
    kept = dict(zip(texts, brute(texts.values(), 35)))
    for doc_id, text in texts.items():
        n = len((text or "").encode().split())
        assert (got[doc_id].n_words, got[doc_id].n_removed) == (n, n - len(kept[doc_id]))
        assert got[doc_id].kept_sha256 == hashlib.sha256(b" ".join(kept[doc_id])).hexdigest()
    assert any(r.n_removed for r in got.values())


def test_odd_rows(spark, odd_docs, no_docs):
    rows = relative_lz.remove_duplicates(odd_docs, 5).collect()
    assert len(rows) == odd_docs.count()
    twice = [r for r in rows if r.doc_id == 1]
    assert [(r.n_words, [tuple(s) for s in r.spans], r.kept) for r in twice] == [(5, [(0, 5)], "")] * 2
    assert [(r.n_words, r.spans, r.kept) for r in rows if r.doc_id in (2, 3, 4)] == [(0, [], "")] * 3
    assert [r.kept for r in rows if r.doc_id is None] == ["zeta eta theta"]
    assert relative_lz.remove_duplicates(no_docs).collect() == []
    only_null = spark.createDataFrame([(None, None)], "doc_id string, text string")
    assert [tuple(r) for r in relative_lz.remove_duplicates(only_null).collect()] == [(None, 0, [], "")]


def test_many_equal_rows_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(7, "p " + " ".join(f"v{i}" for i in range(60)))] * 500 + [(8, long), (9, "q " + long[6_000:300_000])]
    got = relative_lz.remove_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.n_words, r.kept) for r in got if r.doc_id == 7} == {(61, "")}
    kept = next(r.kept for r in got if r.doc_id == 9)
    assert kept.encode().split() == brute([long, "q " + long[6_000:300_000]], 35)[1]


def test_texts_are_cut_into_phrases_once(spark):
    """Texts are read for their phrases, for the words of some and for the result, not once more for repeated anchors."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    texts = random_texts(random.Random(4), 80, 300, 400)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    got = {r.doc_id: r.kept for r in relative_lz.remove_duplicates(rows).collect()}
    assert got == {i: b" ".join(w).decode() for i, w in enumerate(brute(texts, 35))}
    assert read.value <= 3 * len(texts)
