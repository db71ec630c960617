"""Quote validation, retries, budget gate, rendering, receipts and sinks."""

import json
import tempfile

from pyspark.sql import functions as F

from reviewlens.operators import receipts, render, rounds, summarise, themes
from reviewlens.sources import landing

REPS = [("p", 1, 1, "doc_1", 5, "The app crashes on login every time"),
        ("p", 1, 2, "doc_2", 1, "Support never answers my tickets")]


def _reps(spark):
    return spark.createDataFrame(REPS, "product string, cluster_id int, rank int, doc_id string, rating int, text string")


def _attempts(spark, quotes_by_attempt):
    rows = []
    for a, quotes in enumerate(quotes_by_attempt, 1):
        body = json.dumps({"theme_name": "Login", "description": "d", "action_ideas": [],
                           "quotes": [{"text": t, "doc_id": d, "rating": 5} for t, d in quotes]}) \
            if quotes is not None else "{not json"
        rows.append(("p", 1, a, body, 100))
    return spark.createDataFrame(rows, "product string, cluster_id int, attempt int, response string, completion_tokens long")


def _check(spark, quotes_by_attempt):
    parsed = themes.parse_responses(_attempts(spark, quotes_by_attempt))
    v = themes.quote_verdicts(parsed, _reps(spark))
    return themes.attempt_verdicts(parsed, v)


def test_quote_verdicts(spark):
    got = {r.attempt: (r.valid, r.reason) for r in _check(spark, [
        [("crashes on login", "doc_1"), ("never answers", "doc_2")],
        [("crashes at login", "doc_1")],
        [("crashes on login", "doc_9")],
        [("", "doc_1")],
        [("CRASHES on login", "doc_1")],
        None,
    ]).collect()}
    assert got == {1: (True, None), 2: (False, "not_verbatim"), 3: (False, "unknown_doc"),
                   4: (True, None), 5: (False, "not_verbatim"), 6: (False, "invalid_json")}


def test_retry_then_drop_quotes(spark):
    bad = [("paraphrase", "doc_1")]
    res = themes.resolve_attempts(_check(spark, [bad, bad, bad])).collect()
    final = [r for r in res if r.final][0]
    assert final.attempt == 3 and final.outcome == "theme" and final.keep_quotes is False
    res2 = themes.resolve_attempts(_check(spark, [bad, [("crashes", "doc_1")], bad])).collect()
    assert [r.attempt for r in res2 if r.performed] == [1, 2]
    res3 = themes.resolve_attempts(_check(spark, [None, None, None])).collect()
    assert [r.outcome for r in res3 if r.final] == ["skipped"]


def test_budget_gate(spark):
    rows = [("p", 1, 1, 1, 400, 100, True, True, "theme"), ("p", 2, 2, 1, 400, 100, True, True, "theme"),
            ("p", 3, 3, 1, 400, 100, True, True, "theme")]
    df = spark.createDataFrame(rows, "product string, cluster_id int, rank int, attempt int, prompt_tokens long, "
                                     "completion_tokens long, performed boolean, final boolean, outcome string")
    g = {r.rank: r.admitted for r in themes.budget_gate(df, budget=1900).collect()}
    # used before rank 3 = 1000; 1000 + 400 + 500 = 1900 >= 1900 -> refused (equality refuses)
    assert g == {1: True, 2: True, 3: False}
    g2 = {r.rank: r.admitted for r in themes.budget_gate(df, budget=10_000, requests_cap=2).collect()}
    assert g2 == {1: True, 2: True, 3: False}


def test_token_estimate_range(spark):
    df = spark.range(1).select(themes.estimate_tokens(F.array(
        F.struct(F.lit("system").alias("role"), F.lit("You are helpful.").alias("content")),
        F.struct(F.lit("user").alias("role"), F.lit("Summarise this review please.").alias("content")))).alias("n"))
    assert 10 <= df.first().n <= 40


def test_render_report_and_email(spark):
    t = spark.createDataFrame([("Acme", 1, "Fast app", 10, 4.5, "Users like speed.",
                                [("so fast", "doc_1", 5)], [("Keep it", "Profile regularly.")])],
                              "product string, theme_rank int, theme_name string, review_count long, avg_rating double, "
                              "description string, quotes array<struct<text:string,doc_id:string,rating:int>>, "
                              "action_ideas array<struct<title:string,detail:string>>")
    n = render.nest_themes(t)
    rep = n.select(render.report_text(n, F.lit("2026-W24"), 4, "Weekly Review Digest").alias("r")).first().r
    assert "Acme" in rep and "2026-W24" in rep and "1. Fast app (10 reviews, Avg Rating: 4.5)" in rep
    assert '> "so fast" (5/5)' in rep and "- Keep it: Profile regularly." in rep and rep.endswith("---\n\n")
    e = n.select(*render.email_columns(F.lit("2026-W24"), F.lit("abc"), "Review Digest")).first()
    assert "Acme" in e.subject and "2026-W24" in e.subject
    assert "Fast app (10 reviews)" in e.text_body and e.doc_link.endswith("/d/abc") and e.doc_link in e.html_body
    e2 = n.select(*render.email_columns(F.lit("2026-W24"), F.lit(""), "Review Digest")).first()
    assert e2.doc_link == "https://docs.google.com/"


def test_receipts_latest_outbox_and_files(spark):
    v = spark.createDataFrame([
        ("a:w1", 1, "t", 5, 0, 0, "pending", None, "pending", None),
        ("a:w1", 2, "t", 5, 0, 0, "appended", "d", "failed", None),
        ("a:w2", 1, "t", 5, 0, 0, "appended", "d", "drafted", "m"),
        ("a:w3", 1, "t", 5, 0, 0, "pending", None, "pending", None),
        ("a:w3", 2, None, 5, 0, 0, "pending", None, "pending", None),
    ], "idempotency_key string, version long, run_timestamp string, reviews_ingested long, clusters_found long, "
       "themes_generated long, doc_status string, doc_id string, gmail_status string, draft_id string")
    cur = receipts.latest(v)
    assert {r.idempotency_key: r.version for r in cur.collect()} == {"a:w1": 2, "a:w2": 1}
    out = [(r.idempotency_key, r.channel, r.depends_on) for r in receipts.delivery_outbox(cur).collect()]
    assert out == [("a:w1", "gmail", None)]
    new = spark.createDataFrame([("a:w1", 7), ("a:w3", 7)], "idempotency_key string, reviews_ingested long")
    added = receipts.insert_if_absent(v, new)
    assert [(r.idempotency_key, r.version) for r in added.collect()] == [("a:w3", 3)]  # above the broken version 2
    d = tempfile.mkdtemp(prefix="rl-rcpt-")
    with open(f"{d}/r.json", "w") as f:
        f.write(json.dumps({"idempotency_key": "k1", "run_timestamp": "t", "review_window": {},
                            "reviews_ingested": 3, "delivery": {"google_doc": {"status": "appended"}}}) + "\n")
        f.write(json.dumps({"idempotency_key": "k2", "run_timestamp": "t",
                            "delivery": {"google_doc": {"status": "x", "bogus": 1}}}) + "\n")
        f.write("{broken\n")
        f.write(json.dumps({"idempotency_key": "k3", "run_timestamp": "t"}) + "\n")
    got = {r.idempotency_key: (r.doc_status, r.gmail_status, r.clusters_found)
           for r in receipts.read_receipts(spark, f"{d}/r.json").filter("not broken").collect()}
    assert got == {"k1": ("appended", "pending", 0), "k3": ("pending", "pending", 0)}
    with open(f"{d}/v.json", "w") as f:
        f.write(json.dumps({"idempotency_key": "k", "run_timestamp": "t", "version": 1}) + "\n")
        f.write(json.dumps({"idempotency_key": "k", "run_timestamp": "t", "version": 2,
                            "delivery": {"gmail": {"status": "x", "bogus": 1}}}) + "\n")
    assert receipts.latest(receipts.read_receipts(spark, f"{d}/v.json")).count() == 0  # the broken newest hides version 1


def test_short_attempt_lists_end_at_their_last(spark):
    rows = [("p", 1, 1, True, False), ("p", 2, 1, False, False), ("p", 3, 1, True, False), ("p", 3, 2, True, True)]
    df = spark.createDataFrame(rows, "product string, cluster_id int, attempt int, parse_ok boolean, valid boolean")
    got = {(r.cluster_id, r.attempt): (r.final, r.outcome, r.keep_quotes) for r in themes.resolve_attempts(df).collect()}
    assert got == {(1, 1): (True, "theme", False), (2, 1): (True, "skipped", False),
                   (3, 1): (False, None, None), (3, 2): (True, "theme", True)}


def test_extractive_themes_quote_verbatim(spark):
    texts = [(1, 1, "Login fails. The login page crashes every single time I open it!", 1), (2, 1, "Login broken again", 1),
             (3, 2, "Lovely charts and colours.\nGreat", 5), (4, 2, "", 5), (5, -1, "Nothing about login here", 3)]
    members = spark.createDataFrame([("p", s, c, f"doc_{s}", r, t) for s, c, t, r in texts],
                                    "product string, seq long, cluster_id int, doc_id string, rating int, text string")
    reps = members.filter("cluster_id > 0").withColumn("rank", F.col("seq").cast("int"))
    ranked = spark.createDataFrame([("p", 1, 1, 2, 1.0), ("p", 2, 2, 2, 5.0)],
                                   "product string, cluster_id int, rank int, size long, avg_rating double")
    got = {r.cluster_id: r for r in summarise.extractive_themes(ranked, reps, members).collect()}
    assert [q.text for q in got[1].quotes] == ["Login fails.", "Login broken again"]
    assert [q.text for q in got[2].quotes] == ["Great", ""]
    assert got[1].theme_name == "again / broken / crashes" and got[1].description == "2 reviews, most about " + got[1].tag
    assert got[1].action_ideas[0].title and got[2].action_ideas[0].detail
    attempts = spark.createDataFrame([("p", k, 1, True, r.asDict(recursive=True)) for k, r in got.items()],
                                     "product string, cluster_id int, attempt int, parse_ok boolean, parsed struct<"
                                     "quotes: array<struct<text: string, doc_id: string, rating: int>>>")
    assert {r.verdict for r in themes.quote_verdicts(attempts, reps).collect()} == {"ok"}


def test_outcomes_fold_back_as_new_versions(spark):
    cols = ("idempotency_key string, version long, run_timestamp string, reviews_ingested long, clusters_found long, "
            "themes_generated long, doc_status string, doc_id string, gmail_status string, draft_id string")
    v = spark.createDataFrame([("a:w1", 4, "t", 5, 0, 0, "pending", None, "pending", None),
                               ("a:w2", 1, "t", 5, 0, 0, "appended", "d", "failed", None)], cols)
    results = spark.createDataFrame([("a:w1", "google_doc", False, "x"), ("a:w2", "gmail", True, "m")],
                                    "idempotency_key string, channel string, ok boolean, ref string")
    cur = receipts.latest(v)
    new = receipts.upsert(v, receipts.record_outcome(cur, results))
    got = {r.idempotency_key: (r.version, r.doc_status, r.doc_id, r.gmail_status, r.draft_id) for r in new.collect()}
    assert got == {"a:w1": (5, "failed", None, "pending", None), "a:w2": (2, "appended", "d", "drafted", "m")}
    both = receipts.latest(v.unionByName(new))
    assert [r.version for r in receipts.status_of(both, "a:w1").collect()] == [5]
    assert receipts.status_of(both, "a:w9").count() == 0


def test_usage_by_day(spark):
    g = spark.createDataFrame([("p", 1, 1, True, 10, "2026-06-10 23:59:00"), ("p", 1, 2, True, 5, "2026-06-11 00:01:00"),
                               ("p", 2, 1, False, 99, "2026-06-11 00:02:00")],
                              "product string, cluster_id int, attempt int, admitted boolean, used_tokens long, at string")
    daily = themes.usage_daily(themes.usage_records(g, F.col("at").cast("timestamp")))
    assert sorted((str(r.day), r.requests, r.tokens) for r in daily.collect()) == [("2026-06-10", 1, 10), ("2026-06-11", 1, 5)]


def test_sinks_partition_overwrite(spark):
    d = tempfile.mkdtemp(prefix="rl-sink-")
    df = spark.createDataFrame([("p", "2026-W24", "r1", "a", 5, "t", "ts", 1, None),
                                ("p", "2026-W25", "r2", "b", 4, "t", "ts", 0, "1.0")],
                               "product string, iso_week string, review_id string, author string, rating int, "
                               "text string, timestamp string, thumbs_up int, app_version string")
    landing.write_anonymised(df, f"{d}/anon")
    landing.write_anonymised(df.filter("iso_week = '2026-W25'").withColumn("rating", F.lit(1)), f"{d}/anon")
    back = spark.read.json(f"{d}/anon")
    assert sorted((r.iso_week, r.rating) for r in back.collect()) == [("2026-W24", 5), ("2026-W25", 1)]
    assert "author" not in back.columns and "review_id" not in back.columns


def _prompts(spark, clusters=(0, 1, 2)):
    ranked = spark.createDataFrame([("p", c, c + 1, 2, 3.0) for c in clusters],
                                   "product string, cluster_id int, rank int, size long, avg_rating double")
    reps = spark.createDataFrame([("p", c, r, f"doc_{c}{r}", 2 + r, f"Cluster {c} text number {r} is here. More of it.")
                                  for c in clusters for r in (1, 2)],
                                 "product string, cluster_id int, rank int, doc_id string, rating int, text string")
    return themes.cluster_prompts(ranked, reps), reps


def test_theme_rounds_ask_only_rejected_clusters_again(spark):
    """Cluster 0 is right at once, 1 after an unknown document, 2 answers with broken JSON to the end."""
    def answer(prompts):
        out = []
        for m in prompts:
            doc = m[1]["content"].split("doc_id: ")[1].split(" ")[0]
            quote = {"text": "is here.", "doc_id": doc if doc != "doc_11" or len(m) > 2 else "doc_x", "rating": 3}
            body = {"theme_name": f"{doc} after {len(m)}", "description": "", "quotes": [quote], "action_ideas": []}
            out.append(("{" if doc == "doc_21" else json.dumps(body), len(m)))
        return out

    prompts, reps = _prompts(spark)
    made = rounds.theme_rounds(prompts, reps, answer)
    got = {(r.cluster_id, r.attempt): r for r in themes.resolve_attempts(made).collect()}
    assert sorted(got) == [(0, 1), (1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]
    assert got[1, 1].reason == "unknown_doc" and got[1, 2].valid and got[1, 2].parsed.theme_name == "doc_11 after 4"
    assert got[1, 2].messages[2].role == "assistant"
    assert got[1, 2].messages[3].content.startswith("Validation error: Quote references unknown doc_id 'doc_x'.")
    assert [len(got[2, k].messages) for k in (1, 2, 3)] == [2, 2, 2]
    assert got[2, 3].outcome == "skipped" and got[0, 1].outcome == got[1, 2].outcome == "theme"
    assert {r.prompt_tokens for k, r in got.items() if k[0] == 1} == {got[1, 1].prompt_tokens}


def test_extractive_answer_shortens_then_quotes_whole(spark):
    long = "a sentence of very many words that goes on and on until nobody listens any more. Then."
    ask = rounds.extractive_answer()
    user = {"role": "user", "content": f"Reviews:\n[doc_id: doc_1 | Rating: 1/5]\n{long}\n\n---\n[doc_id: doc_2 | Rating: 5/5]\nFine.\n"}
    first, again = (json.loads(ask([m])[0][0]) for m in ([{}, user], [{}, user, {}, {}]))
    assert first["quotes"][0]["text"].endswith("…") and first["quotes"][0]["text"][:-1] in long
    assert [q["text"] for q in again["quotes"]] == [long.split(" Then")[0], "Fine."]
    assert first["action_ideas"] == [{"title": "Escalate", "detail": "Start with doc_1."}]


def test_theme_rounds_on_no_clusters(spark):
    prompts, reps = _prompts(spark)
    made = rounds.theme_rounds(prompts.filter("false"), reps.filter("false"), rounds.extractive_answer())
    assert themes.resolve_attempts(made).count() == 0
