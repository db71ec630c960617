"""Quality gate, window, dedup and redaction on small fixtures."""

from pyspark.sql import functions as F

from reviewlens.functions.redact import redact_columns
from reviewlens.operators import ingest
from reviewlens.schemas import RAW_RECORD

NOW = "2026-06-10 00:00:00"


def _redact(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return [(r.text, r.n) for r in redact_columns(df, "text", "text", "n").collect()]


def test_redaction_examples(spark):
    got = _redact(spark, [
        "Mail a.b@example.com today",
        "Call me at +91-9876543210 now",
        "Number 9876543210 here",
        "Dial 987-654-3210 please",
        "Tax id ABCDE1234F.",
        "id 1234 5678 9012 ok",
        "id 1234-5678-9012 ok",
        "id 123456789012 ok",
        "Send to name@okbank",
        "Nothing personal here",
        None,
        "",
        "1234567890123456",
    ])
    assert got[0] == ("Mail [REDACTED] today", 1)
    assert got[1] == ("Call me at [REDACTED] now", 1)
    assert got[2] == ("Number [REDACTED] here", 1)
    assert got[3] == ("Dial [REDACTED] please", 1)
    assert got[4] == ("Tax id [REDACTED].", 1)
    assert got[5] == ("id [REDACTED] ok", 1)
    assert got[6] == ("id [REDACTED] ok", 1)
    assert got[7] == ("id [REDACTED] ok", 1)
    assert got[8] == ("Send to [REDACTED]", 1)
    assert got[9] == ("Nothing personal here", 0)
    assert got[10] == (None, 0)
    assert got[11] == ("", 0)
    assert got[12] == ("[REDACTED]456", 1)


def test_redaction_mixed_line_and_idempotent(spark):
    [(t, n)] = _redact(spark, ["Rahul a@b.io 9876543210 ABCDE1234F"])
    assert n == 3 and t == "Rahul [REDACTED] [REDACTED] [REDACTED]"
    [(t2, n2)] = _redact(spark, [t])
    assert t2 == t and n2 == 0


def test_bounded_scan_orders_and_cap(spark):
    text = "one two three four five six seven eight"
    rows = [("p", s, f"r{s}", s % 5 + 1, text, f"2026-06-{s % 28 + 1:02d}T00:00:00", s % 7, "en") for s in range(400)]
    df = spark.createDataFrame(rows, "product string, seq long, review_id string, rating int, text string, "
                                     "timestamp string, thumbs_up int, lang string")
    want = {"rating": sorted(range(400), key=lambda s: (-(s % 5), s))[:30],
            "most_relevant": sorted(range(400), key=lambda s: (-(s % 7), s))[:30],
            "newest": sorted(range(400), key=lambda s: (-(s % 28), s))[:30]}
    for mode, seqs in (*want.items(), ("unlisted", want["newest"])):
        assert sorted(r.seq for r in ingest.bounded_scan(df, 30, mode).collect()) == sorted(seqs)


def test_responses_decode_to_their_reviews(spark):
    rows = [("p", 1, "r1", "A \"b\"", 5, "line\none é", "2026-06-01", 3, None), ("p", 2, "r2", "", 1, "x", "", 0, "1.0")]
    df = spark.createDataFrame(rows, "product string, seq long, review_id string, author string, rating int, text string, "
                                     "timestamp string, thumbs_up int, app_version string")
    back = ingest.decode_tool_response(ingest.response_rows(df)).select(*ingest.RESPONSE_FIELDS, "reject")
    assert sorted(tuple(r) for r in back.collect()) == [(*r[2:], False) for r in rows]


def test_quality_gate(spark):
    rows = [
        ("a", "five words are right here", "en"),
        ("b", "one two three four five six seven eight", "en"),
        ("c", "one two three four five six seven eight \U0001F680", "en"),
        ("d", "uno dos tres cuatro cinco seis siete ocho", "es"),
        ("e", None, "en"),
        ("f", "   ", "en"),
        ("g", "one two three four five six seven eight", "en"),
        ("h", "seven words only in this short line", "en"),
        ("i", "one two three four five six seven eight ©", "en"),
    ]
    df = spark.createDataFrame(rows, "id string, text string, lang string")
    got = {r.id: r.reason for r in df.select("id", ingest.reject_reason().alias("reason")).collect()}
    assert got == {"a": "too_short", "b": None, "c": "emoji", "d": "not_english", "e": "empty",
                   "f": "empty", "g": None, "h": "too_short", "i": "emoji"}


def test_record_mapping_keeps_order(spark):
    good = "this is a perfectly fine review with many words in it"
    raw = spark.createDataFrame([
        (0, "r1", "u1", 5, good, "2026-06-09T09:12:34", 3, "1.2"),
        (1, "r2", "u2", 4, "too short", "2026-06-09T09:12:34", 0, None),
        (2, "r3", None, None, good + " \U0001F600", "2026-06-09T09:12:34", None, None),
        (3, "r4", None, None, good, None, None, None),
    ], "seq long, reviewId string, userName string, score int, content string, at string, thumbsUpCount int, reviewCreatedVersion string")
    assert [f.name for f in RAW_RECORD.fields] == raw.columns[1:]
    df = ingest.map_records(raw, "app").withColumn("lang", F.lit("en"))
    got = ingest.quality_gate(df).orderBy("seq").collect()
    assert [r.review_id for r in got] == ["r1", "r4"]
    assert got[1].author == "" and got[1].rating == 0 and got[1].thumbs_up == 0 and got[1].app_version is None


def test_window_dedup_chain(spark):
    rows = [
        (0, "id1", "now", "2026-06-09T00:00:00"),
        (1, "id2", "old", "2026-03-01T00:00:00"),
        (2, "id3", "phone 9876543210 inside", "2026-06-09T00:00:00Z"),
        (3, "id1", "dup", "2026-06-09T00:00:00"),
        (4, "id5", "junk time", "not-a-date"),
        (5, "id6", "exact cutoff", "2026-03-18T00:00:00"),
        (6, "id7", "offset", "2026-06-09T10:00:00+05:30"),
        (7, "id8", "future", "2030-01-01T00:00:00"),
    ]
    df = spark.createDataFrame(rows, "seq long, review_id string, text string, timestamp string") \
        .withColumn("author", F.lit("someone")).withColumn("product", F.lit("p"))
    w = ingest.rolling_window(df, NOW, 12)
    assert sorted(r.review_id for r in w.collect()) == ["id1", "id1", "id3", "id5", "id6", "id7", "id8"]
    d = ingest.dedup_keep_first(w)
    got = {r.review_id: r.seq for r in d.collect()}
    assert got["id1"] == 0 and len(got) == 6
    red = ingest.redact_reviews(d).filter("review_id = 'id3'").first()
    assert red.text == "phone [REDACTED] inside" and red.redactions == 1


def test_dedup_first_copy_outside_window(spark):
    rows = [(0, "x", "2026-01-01T00:00:00"), (1, "x", "2026-06-01T00:00:00")]
    df = spark.createDataFrame(rows, "seq long, review_id string, timestamp string")
    out = ingest.dedup_keep_first(ingest.rolling_window(df, NOW, 12)).collect()
    assert [r.seq for r in out] == [1]


def test_decode_tool_response(spark):
    obj = '{"review_id":"a","author":"b","rating":5,"text":"t","timestamp":"x","thumbs_up":1}'
    wrapped = '"' + obj.replace('"', '\\"') + '"'
    missing = '{"review_id":"a"}'
    df = spark.createDataFrame([(obj,), (wrapped,), (missing,)], "value string")
    got = ingest.decode_tool_response(df).collect()
    assert [r.reject for r in got] == [False, False, True]
    assert got[1].review_id == "a" and got[1].app_version is None


def test_min_words_equals_count_property(spark):
    import random
    from reviewlens.functions.text import has_min_words, word_count
    rnd = random.Random(7)
    seps = [" ", "\t", "\n", " ", " ", "　", "\x1c", "\x85"]
    texts = []
    for _ in range(300):
        k = rnd.randint(0, 12)
        parts = [rnd.choice(["a", "bb", "ccc", "é", "\U0001F680", "x-y"]) for _ in range(k)]
        texts.append(rnd.choice(["", " "]) + "".join(p + rnd.choice(seps) * rnd.randint(1, 2) for p in parts))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(word_count("t").alias("n"), has_min_words("t", 8).alias("ok")).collect()
    assert all((r.n >= 8) == r.ok for r in rows)
    assert any(r.ok for r in rows) and any(not r.ok for r in rows)


def test_times_without_separators(spark):
    from reviewlens.functions.dates import parse_time
    given = {"20260609T091234": "2026-06-09 09:12:34", "20260609": "2026-06-09 00:00:00", "20260609T0912": "2026-06-09 09:12:00",
             "20260609T091234.5Z": "2026-06-09 09:12:34.5", "20260609 091234+02:00": "2026-06-09 07:12:34",
             "2026-06-09T09:12:34": "2026-06-09 09:12:34", "20261309": None, "2026060": None, "202606091": None, "T091234": None}
    rows = spark.createDataFrame([(k,) for k in given], "t string").select("t", parse_time("t").cast("string").alias("got"))
    assert {r.t: r.got for r in rows.collect()} == given
