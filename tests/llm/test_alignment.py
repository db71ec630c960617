import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from reviewlens.llm import alignment, queries
from tests.llm.conftest import SF

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabularies():
    return alignment.byte_level(JSON, public_tokenizers.PATTERN), alignment.pieces(MODEL)


@pytest.fixture(scope="module")
def plain():
    """The two tokenizers as their own libraries run them, and their tokens' bytes."""
    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    byte_of = alignment.byte_alphabet()
    a_bytes = {i: bytes(byte_of[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]
    return a, b, a_bytes, b_bytes


def brute(texts, plain):
    """Rows (n_a, n_b, groups, links) of each text and the corpus counts, with sets of byte positions."""
    a, b, a_bytes, b_bytes = plain
    rows, counts = [], Counter()
    for text in texts:
        groups, links = [], []
        a_ids = a.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = b.encode(text) if text else []
        data = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[i] for i in a_ids) != data or b"".join(b_bytes[i] for i in b_ids) != data:
            rows.append((0, 0, [], []))
            continue
        i = j = at_a = at_b = 0
        group = ([], [])
        while i < len(a_ids) or j < len(b_ids):
            if at_a <= at_b:
                group[0].append(a_ids[i])
                start, at_a, i = at_a, at_a + len(a_bytes[a_ids[i]]), i + 1
            else:
                group[1].append(b_ids[j])
                start, at_b, j = at_b, at_b + len(b_bytes[b_ids[j]]), j + 1
            if at_a == at_b:
                groups.append(group)
                group = ([], [])
        starts = {}
        for side, ids, sizes in ((0, a_ids, a_bytes), (1, b_ids, b_bytes)):
            at, spans = 0, []
            for t in ids:
                spans.append((at, at + len(sizes[t]), t))
                at += len(sizes[t])
            starts[side] = spans
        k = 0
        for lo, hi, t in starts[0]:
            while starts[1][k][1] <= lo:
                k += 1
            m = k
            while m < len(starts[1]) and starts[1][m][0] < hi:
                links.append((t, starts[1][m][2]))
                m += 1
        counts.update(set(links))
        rows.append((len(a_ids), len(b_ids), groups, links))
    best = defaultdict(int)
    for (t, _), n in counts.items():
        best[t] = max(best[t], n)
    out = []
    for n_a, n_b, groups, links in rows:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return out, counts


def values(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


ODD = ["", None, " ", "  a  b  ", "a ▁ b", "<s> <|endoftext|> <unk> <0x41>", "é ﬁ Ⅷ 你好 мир 🙂👍🏽   x", "\n\n\t \r\n x",
       "x" * 3000, "ha" * 500, "aaa bbb  ccc   ddd    " * 50, "\x00\x01 nul", "it's we'll I'M", "=" * 333 + "-" * 77, "ａｂｃ﻿​"]


def test_query_against_brute_force(spark, texts, plain):
    got = {r.doc_id: r for r in queries.op12_alignment(spark, SF).collect()}
    expected, _ = brute(texts.values(), plain)
    assert {i: values(r) for i, r in got.items()} == dict(zip(texts, expected))
    assert sum(r.n_a > 0 for r in got.values()) > 100


@pytest.mark.parametrize("chunk,block,frequent", [(1 << 16, 1 << 20, 1 << 16), (20, 100, 1 << 16), (7, 1, 50), (1 << 16, 1 << 20, 0)])
def test_odd_texts_cut_anywhere_against_brute_force(spark, monkeypatch, vocabularies, plain, chunk, block, frequent):
    for name, value in (("CHUNK", chunk), ("BLOCK", block), ("FREQUENT", frequent)):
        monkeypatch.setattr(alignment, name, value)
    rng = random.Random(chunk)
    alphabet = "ab c déß▁你 .,'\n  1234"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(60)] + ["twice over"] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in alignment.align(rows, *vocabularies, keep_groups=True).collect()}
    expected, counts = brute(texts, plain)
    assert [values(got[i]) for i in range(len(texts))] == expected
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got.values() if r.n_a)
    pairs = alignment.pair_counts(rows, *vocabularies).collect()
    assert {(r.a, r.b): r.n for r in pairs} == dict(counts) and len(pairs) == len(counts)


def test_encoders_agree_on_every_kind_of_character(vocabularies, plain):
    rng, encode = random.Random(5), vocabularies[0].start()
    texts = [chr(c) + "x " + chr(c) + chr(c) for c in range(0x250)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0x3000, 0xD800), 32, 10, 39, 115]))
                      for _ in range(12)) for _ in range(2000)]
    mine = encode(texts)
    theirs = [e.ids for e in plain[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert sum(m != t for m, t in zip(mine, theirs)) == 0


def test_odd_rows(spark, vocabularies, odd_docs, no_docs):
    rows = alignment.align(odd_docs, *vocabularies).collect()
    assert len(rows) == odd_docs.count()
    assert [values(r) for r in rows if r.doc_id in (2, 3)] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert len({values(r) for r in rows if r.doc_id == 1}) == 1
    assert alignment.align(no_docs, *vocabularies).collect() == []
    only_null = spark.createDataFrame([(None, None)], "doc_id string, text string")
    assert [r.n_a for r in alignment.align(only_null, *vocabularies).collect()] == [0]
