import hashlib
import random
import zlib

import numpy as np
import pytest

from reviewlens.llm import periodic, queries
from tests.llm.conftest import SF


def brute_runs(words, min_length=24, min_exponent=3):
    """Every maximal stretch of every period, by comparing all words at all lags."""
    found = []
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            end = i
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            length = end - i + q
            if length >= max(min_length, min_exponent * q):
                stretch = words[i:i + length]
                if not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                    found.append((i, length, q))
            i = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_kept(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def random_words(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(200))]
    if kind == 1:  # Thue-Morse has no cube
        return [str(bin(i).count("1") % 2) for i in range(rng.randrange(300))]
    out = []
    while len(out) < 250:
        unit = [rng.choice("abcde") for _ in range(rng.randrange(1, 40))]
        out += (unit * rng.randrange(1, 7))[:rng.randrange(1, 160)]
        if kind == 3:
            out += unit[:5] + out[-30:]
    return out[:rng.randrange(1, 400)]


@pytest.mark.parametrize("min_length,min_exponent", [(24, 3), (5, 3), (40, 4)])
def test_all_runs_against_brute_force(min_length, min_exponent):
    rng = random.Random(1)
    for _ in range(150):
        words = random_words(rng)
        ids = np.array([hash(w) % 1000 for w in words], np.int64)
        expected = brute_runs(words, min_length, min_exponent)
        assert periodic.runs_of(ids, min_length, min_exponent) == expected, words
        kept = periodic.kept_words(len(words), expected)
        assert [w for w, k in zip(words, kept) if k] == brute_kept(words, expected)


def test_unit_whose_grams_repeat_inside_it():
    a, b, c = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)], [f"c{i}" for i in range(30)]
    unit = a + b + a + c + b + a + c + a + b + c  # every 16-gram comes several times before the unit ends
    words = ["x"] + unit * 4 + ["y"]
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    assert periodic.runs_of(np.array([numbers[w] for w in words])) == [(1, 4 * len(unit), len(unit))]


def test_one_word_over_and_over_is_one_run():
    assert periodic.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]


def test_query_against_brute_force(spark, texts):
    got = {r.doc_id: r for r in queries.op11_periodic(spark, SF).collect()}
    assert set(got) == set(texts)
    for doc_id, text in texts.items():
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue  # too slow by brute force
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(brute_kept(words, runs))).hexdigest()


def test_odd_rows(odd_docs, no_docs):
    rows = periodic.find_runs(odd_docs, min_length=3).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.runs is not None and r.collapsed is not None for r in rows)
    assert [(r.n_words, r.runs, r.collapsed) for r in rows if r.doc_id in (2, 3, 4)] == [(0, [], "")] * 3
    assert periodic.find_runs(no_docs).collect() == []


def test_long_text_with_runs(spark):
    text = "x " * 50_000 + " ".join(f"w{i}" for i in range(50_000)) + " u v" * 60_000
    r = periodic.find_runs(spark.createDataFrame([("id", text)], "doc_id string, text string")).first()
    assert [tuple(x) for x in r.runs] == [(0, 50_000, 1), (100_000, 120_000, 2)]
    assert r.collapsed == "x " + " ".join(f"w{i}" for i in range(50_000)) + " u v"


def test_exponent_below_three_is_refused(no_docs):
    with pytest.raises(ValueError):
        periodic.find_runs(no_docs, min_exponent=2)
