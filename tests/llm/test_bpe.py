import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewlens.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TOKENS = bpe.load_ranks(None, PATH)
VOCABULARY = bpe.Vocabulary(TOKENS, bpe.halves_of(TOKENS))
ENCODER = bpe.Encoder(VOCABULARY, PATTERN)
KNOWN = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})
LETTERS = "abcdefghij stréèñßüö   \n\t0123.,!?'-—你好日🎉𝔘ـعر\x1c <|>"


@settings(max_examples=150, deadline=None)
@given(st.text(LETTERS, max_size=40))
def test_encodes_like_the_library(text):
    assert ENCODER.encode(text) == KNOWN.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.binary(max_size=8), st.integers(0, 60))
def test_prefixes_append_and_edit(data, more, at):
    rank_of = VOCABULARY.rank_of
    want = lambda x: [rank_of[p] for p in bpe.merge_by_rank(x, rank_of)]
    table = bpe.Prefixes(VOCABULARY).append(data)
    assert table.ids() == want(data)
    assert bpe.PrefixTables(VOCABULARY).ids([data, data[::-1]])[0].tolist() == want(data) + want(data[::-1]) \
        if len(data) <= bpe.PrefixTables.LONGEST else True
    at = min(at, len(data))
    assert table.edit(at, min(len(data), at + 3), more).ids() == want(data[:at] + more + data[at + 3:])
    assert bpe.Prefixes(VOCABULARY).append(data).append(more).ids() == want(data + more)


@settings(max_examples=150, deadline=None)
@given(st.text(LETTERS, max_size=30), st.text(LETTERS, max_size=8), st.integers(0, 30), st.booleans())
def test_reencodes_near_edits(text, new, at, append):
    at = len(text) if append else min(at, len(text))
    edited = text[:at] + new + ("" if append else text[at + 2:])
    assert bpe.reencode(ENCODER, text, KNOWN.encode_ordinary(text), at, edited) == KNOWN.encode_ordinary(edited)


def test_table_round_trip(spark, docs, texts):
    for r in bpe.digest(docs.select("doc_id", "text"), PATH, PATTERN).collect():
        ids = KNOWN.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_memory_is_bounded(monkeypatch, texts):
    monkeypatch.setattr(bpe, "MEMO", 50)
    small = bpe.Encoder(VOCABULARY, PATTERN)
    for text in list(texts.values())[:20]:
        assert small.encode(text) == KNOWN.encode_ordinary(text)


def test_odd_rows(odd_docs, no_docs):
    got = bpe.round_trip(odd_docs, PATH, PATTERN)
    rows = got.collect()
    again = bpe.decode(bpe.encode(odd_docs, PATH, PATTERN), PATH)
    assert sorted(map(str, again.select(got.columns).collect())) == sorted(map(str, rows))
    assert bpe.decode(got.selectExpr("doc_id", "CASE WHEN doc_id <> 2 THEN ids END AS ids"), PATH).filter(
        "doc_id = 2").first().decoded is None
    assert len(rows) == 9 and {"fp", "score", "key"} <= set(got.columns)
    by = {r.doc_id: r for r in rows}
    assert by[2].ids == [] and by[2].decoded == b"" and by[3].ids == []
    assert by[5].decoded == b"x" * 5000 and by[7].decoded.decode() == "Älpha ßeta 你好 мир"
    assert bpe.round_trip(no_docs, PATH, PATTERN).count() == 0


def test_appends_on_a_table(spark):
    rows = [(1, "one two", "one two three"), (2, "", "now text"), (3, "it'", "it're"), (4, None, "x")]
    df = spark.createDataFrame([(i, t, None if t is None else KNOWN.encode_ordinary(t), None if t is None else len(t), e)
                                for i, t, e in rows], "doc_id long, text string, ids array<int>, start int, edited string")
    got = {r.doc_id: r.ids for r in bpe.encode_edited(df, PATH, PATTERN).collect()}
    assert got == {i: KNOWN.encode_ordinary(e) for i, _, e in rows}


def test_ranks_must_be_complete(tmp_path):
    (tmp_path / "v").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bpe.load_ranks(None, str(tmp_path / "v"))
