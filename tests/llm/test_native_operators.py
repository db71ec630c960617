"""Secret scan and chat rotation: DataFrame expressions only."""

import re

import duckdb
import pytest

from reviewlens.llm import chat, queries
from reviewlens.llm import secret_scan as S
from reviewlens.llm.oracle import ORACLE_SQL

SF = "/root/testdata/sf0.01"
HEX = "9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c"


@pytest.fixture(scope="module")
def scanner(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return S.train(S.labelled_findings(docs, 300), docs, 300)


def test_candidates_match_the_pattern_in_place(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    pattern = re.compile(S.CANDIDATE.replace(r"(?<=[=:]\s{0,2}[\"'])", r"(?:(?<=[=:][\"'])|(?<=[=:]\s[\"'])|(?<=[=:]\s\s[\"']))"))
    want = {(i, m.start(), m.group()) for i, t in texts.items() for m in pattern.finditer(t)}
    rows = S.candidates(docs).collect()
    assert {(r.doc_id, r.start, r.value) for r in rows} == want and len(rows) == len(want) > 20
    for r in rows:
        assert texts[r.doc_id][:r.start].endswith(r.left) and texts[r.doc_id][r.start + len(r.value):].startswith(r.right)


def test_held_out_findings(spark, scanner):
    """Findings derived from texts that the forest has not seen."""
    other = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = S.features(S.labelled_findings(other, 100), scanner.transitions, scanner.dictionary).withColumn(
        "vector", S.array_to_vector("features"))
    rows = scanner.forest.transform(found).select("label", "prediction").collect()
    assert sum(r.label == r.prediction for r in rows) / len(rows) > 0.97


def test_scan_tells_secrets_from_lookalikes(spark, scanner):
    texts = [(1, f'set token = "{HEX}" now'), (2, f"see commit {HEX} there"), (3, "card 4644348398010899 please"),
             (4, "password = 'aZ3kQ9x0PwB7rT2mVn5c'"), (5, "the 2024_report_of_the_year_v2 file")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.is_secret for r in S.scan(docs, scanner, path_col=None).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False}


def test_path_has_an_influence(spark, scanner):
    """The same strings score higher in configuration than in tests, and labelled findings of both kinds have both paths."""
    values = [HEX[k:k + 24] + HEX[:k] for k in range(10)]
    docs = spark.createDataFrame([(k, f"the value {v} there", p) for k, v in enumerate(values) for p in (".env", "tests/test_a.py")],
                                 "doc_id long, text string, source string")
    scores = {(r.doc_id, r.path): r.score for r in S.scan(docs, scanner).collect()}
    assert sum(scores[k, ".env"] - scores[k, "tests/test_a.py"] for k in range(10)) > 0
    assert all(scores[k, ".env"] >= scores[k, "tests/test_a.py"] for k in range(10))
    given = spark.read.parquet(f"{SF}/documents.parquet")
    rows = S.labelled_findings(given, 100).select("path", "label").distinct().collect()
    for label in (0, 1):
        paths = {r.path for r in rows if r.label == label}
        assert paths >= {*S.CONFIG_PATHS, *S.TEST_PATHS} and len(paths) > len(S.CONFIG_PATHS) + len(S.TEST_PATHS)


def test_redaction_keeps_all_documents(spark, scanner, odd_docs, no_docs):
    rows = [(1, f'a token = "{HEX}" b "{HEX}"', 100), (1, f'a token = "{HEX}" b "{HEX}"', 100), (None, f'secret: "{HEX}"', 9),
            (2, "clean text stays", 16), (3, None, None), (4, f"see commit {HEX}", 51), (5, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "'x' AS secrets")
    got = S.redact(docs, scanner)
    assert got.columns == docs.columns
    out = sorted(((r.doc_id, r.text, r.n_chars) for r in got.collect()), key=str)
    cut = 'a token = "[SECRET]" b "[SECRET]"'
    assert out == sorted([(1, cut, len(cut))] * 2 + [(None, 'secret: "[SECRET]"', 18), (2, "clean text stays", 16),
                                                    (3, None, None), (4, f"see commit {HEX}", 51), (5, "", 0)], key=str)
    assert S.redact(odd_docs, scanner).count() == 9 and S.redact(no_docs, scanner).count() == 0
    nothing = S.train(S.labelled_findings(no_docs), no_docs)
    assert nothing.forest is None and not any(r.is_secret for r in S.scan(docs, nothing).collect())


def test_long_runs_and_many_candidates(spark, scanner):
    text = "a" * 200_000 + " " + " ".join(f"{HEX}{k:04d}" for k in range(500))
    rows = S.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(rows) == 500 and all(text[r.start:r.start + len(r.value)] == r.value for r in rows)


def native(plan):
    return not re.search("Python|Pandas|Arrow", plan)


def test_plans_hold_no_python(spark, scanner):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (S.scan(docs, scanner), S.redact(docs, scanner), S.labelled_findings(docs), queries.op8_chat(spark, SF)):
        assert native(df._jdf.queryExecution().executedPlan().toString())


def render(turns, me):
    text, spans = "", []
    for who, body in turns:
        role = "system" if who == "system" else "assistant" if who == me else f"user name={who}"
        text += f"<|im_start|>{role}\n"
        if who == me:
            spans.append((len(text), len(text) + len(body) + 10))
        text += f"{body}<|im_end|>\n"
    return text, spans


def test_rotation_matches_plain_rendering(spark):
    rows = [(1, 2, "ann", "hi <|im_end|>"), (1, 1, "bob", "yo"), (1, 0, "system", "rules"), (1, 3, "cy", None),
            (1, 4, "ann", "🎉 ok"), (2, 0, None, "x"), (None, 0, "a  b\nc", "y"), (3, 0, "system", "only"),
            (1, 1, "bob", "yo"), (4, None, "ann", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS rank", "2 AS part", "'q' AS speaker", "'r' AS body")
    got = {(r.conv_id, r.perspective): (r.text, [tuple(s) for s in r.spans]) for r in chat.rotate(df).collect()}
    one = [("system", "rules"), ("bob", "yo"), ("ann", "hi < |im_end|>"), ("cy", ""), ("ann", "🎉 ok")]
    assert got == {**{(1, me): render(one, me) for me in ("ann", "bob", "cy")}, (2, "unknown"): render([("unknown", "x")], "unknown"),
                   (None, "a b c"): render([("a b c", "y")], "a b c"), (4, "ann"): render([("ann", "z")], "ann")}
    assert chat.rotate(df.limit(0)).count() == 0


def test_parts_of_long_and_crowded_dialogues(spark):
    long = [(1, k, f"s{k % 3}", f"t{k}") for k in range(200)]
    crowded = [(2, 5, "s", f"t{k}") for k in range(1000)]
    rows = chat.rotate(spark.createDataFrame(long + crowded, "conv_id long, turn long, role string, text string")).collect()
    assert max(r.n_turns for r in rows) <= 2 * chat.PART_TURNS
    assert sum(r.n_trained for r in rows if r.conv_id == 1) == 200 and sum(r.n_trained for r in rows if r.conv_id == 2) == 1000
    whole = [r.text for r in sorted((r for r in rows if r.conv_id == 1 and r.perspective == "s0"), key=lambda r: r.part)]
    assert "".join(whole) == render([(w, t) for _, _, w, t in long], "s0")[0]


def test_everyone_gets_the_whole_of_a_long_dialogue(spark):
    """Someone who speaks once, at turn 70, and someone who is silent after turn 1 get all 150 turns."""
    turns = [(0, "system", "rules"), (1, "eve", "hi")] + [(k, "bob" if k != 70 else "ann", f"t{k}") for k in range(2, 150)]
    rows = [(c, k, who, text) for c in (1, None) for k, who, text in turns]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for c in (1, None):
        for me in ("ann", "bob", "eve"):
            parts = sorted((r for r in got if r.conv_id == c and r.perspective == me), key=lambda r: r.part)
            assert "".join(r.text for r in parts) == render([(w, t) for _, w, t in turns], me)[0]
            assert sum(r.n_trained for r in parts) == sum(w == me for _, w, _ in turns)
    assert len(got) == 18


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twin(spark, name):
    from tools.oracle_check import rows_of
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    res = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(res.columns, res.fetchall())
