import itertools
import re

import pytest
import xxhash

from reviewlens.llm import simhash_dedup as S
from reviewlens.llm.common import word_blocks


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=2):
    least = {i: i for i in fps}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            x, y = find(a), find(b)
            least[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_fingerprint_matches_the_definition_and_spark_hash(spark, texts):
    for text in [None, "", " \n", "One", "One TWO", "ÄÖ a b c A B C", *list(texts.values())[:40]]:
        assert S.simhash(text, 3) % (1 << 64) == plain_fingerprint(text)
    spark_hash = spark.sql("SELECT xxhash64('one two three') AS h").first().h
    assert spark_hash % (1 << 64) == plain_fingerprint("One Two Three")


def test_word_blocks_cut_nothing():
    text = "a bb\tccc  dddd\n" * 50
    assert [w for b in word_blocks(text, 7) for w in b] == text.encode().split()


@pytest.mark.parametrize("radius", [2, 4])
def test_masks_cover_every_pair_of_positions(radius):
    masks = [m % (1 << 64) for m in S.covering_masks(radius)]
    assert len(masks) == 2 ** (radius + 1) - 1
    for flips in itertools.combinations(range(0, 64, 1 if radius == 2 else 5), radius):
        assert any(not any(m >> i & 1 for i in flips) for m in masks)


def test_matches_brute_force_on_the_table(docs, texts):
    got = {r.doc_id: r for r in S.near_duplicates(docs).collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == plain_components(fps)


def test_links_in_crowded_buckets(spark, monkeypatch):
    """One bucket of hundreds of close fingerprints, and chains that only reach through the middle."""
    base = 0x0F0F0F0F0F0F0F0F
    near = {base ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i + 1)} | {base ^ 7 << 30, base ^ 31 << 30}
    far = {0, 3, 15, 63, (1 << 64) - 1}
    fps = dict(enumerate(sorted(near | far)))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in fps.values()]
    for limit in (S.SMALL_BUCKET, 1):
        monkeypatch.setattr(S, "SMALL_BUCKET", limit)
        links = S.near_links(spark.createDataFrame(signed, "fp long")).collect()
        index = {v: i for i, v in fps.items()}
        assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 2 for r in links)
        from reviewlens.operators.components import components
        roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        group = {}
        for v, i in index.items():
            s = v - (1 << 64) if v >> 63 else v
            group.setdefault(roots.get(s, s), set()).add(i)
        want = {}
        for i, root in plain_components(fps).items():
            want.setdefault(root, set()).add(i)
        assert sorted(map(sorted, group.values())) == sorted(map(sorted, want.values()))


def test_odd_rows(odd_docs, no_docs):
    rows = S.near_duplicates(odd_docs).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert by[2].fp == by[3].fp == by[4].fp == 0 and {by[i].component_id for i in (2, 3, 4)} == {2}
    assert by[None].component_id is None and by[1].component_id == 1
    assert S.near_duplicates(no_docs).count() == 0
    kept = S.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, None, 5, 6, 7], key=str)
    assert S.keep_one(no_docs).count() == 0


def test_only_near_duplicates_go_whatever_their_ids(spark):
    text = {k: " ".join(f"{k}{j}" for j in range(30)) for k in "abcdef"}
    rows = [(None, text["a"], "x"), (None, text["b"], "x"), (None, text["c"], "x"), (None, text["c"], "x"), (3, text["d"], None),
            (5, text["d"], "x"), (5, text["e"], "x"), (None, text["e"], "y"), (6, text["f"], "x"), (6, text["f"], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    got = sorted(((r.doc_id, r.text) for r in S.keep_one(docs).collect()), key=str)
    assert got == sorted([(None, text["a"]), (None, text["b"]), (None, text["c"]), (3, text["d"]), (5, text["e"]), (6, text["f"])], key=str)


def test_long_chain_is_one_component(spark):
    from reviewlens.operators.components import components
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {i: 0 for i in range(1, 61)} | {101: 100}
