"""H1 + H3: themes asked for in rounds from any callable, only rejected clusters again.

The callable gets a list of prompts (each a list of ``{"role", "content"}``
messages) and returns one ``(json_text, completion_tokens)`` per prompt. It
runs on Arrow batches inside tasks; an answer is checkpointed before it is
judged, so it is asked for once even if the callable is not deterministic.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.fixed_values import MAX_ATTEMPTS, SENTIMENT_ACTIONS
from reviewlens.operators import themes
from reviewlens.sources.shared import checkpointed

Answer = Callable[[list[list[dict]]], list[tuple[str | None, int]]]
QUOTED = 3
QUOTE_CHARS = 60
RETRY_REQUEST = ("\nAnswer with the whole JSON again. Copy every quote character by character "
                 "from the review with its doc_id.")


def validation_error(verdict, doc_id, text):
    """What the retry prompt says about the first rejected quote."""
    return F.when(verdict == "unknown_doc", F.concat(F.lit("Quote references unknown doc_id '"), doc_id, F.lit("'."))) \
            .otherwise(F.concat(F.lit("Hallucinated/paraphrased quote for "), doc_id, F.lit(": '"), text, F.lit("'")))


def theme_rounds(prompts: DataFrame, reps: DataFrame, answer: Answer, max_attempts: int = MAX_ATTEMPTS,
                 by: tuple[str, ...] = ("product",)) -> DataFrame:
    """The attempts made (``themes.resolve_attempts`` takes them), with the ``messages`` that each was asked.

    A cluster whose quotes are rejected is asked again with its answer and the
    validation error appended to the messages; after broken JSON the messages
    stay as they are. The token estimate is that of the first messages.
    """
    keys = [*by, "cluster_id"]

    @F.pandas_udf("response string, completion_tokens long")
    def ask(messages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(answer([json.loads(m) for m in messages]), columns=["response", "completion_tokens"])

    pending, made = prompts.select(*keys, "rank", "prompt_tokens", "messages"), []
    for attempt in range(1, max_attempts + 1):
        asked = checkpointed(pending.withColumn("attempt", F.lit(attempt)).withColumn("answer", ask(F.to_json("messages")))
                             .select("*", "answer.*").drop("answer"))
        parsed = themes.parse_responses(asked)
        verdicts = themes.quote_verdicts(parsed, reps, by)
        checked = themes.attempt_verdicts(parsed, verdicts, by)
        made.append(checked)
        if attempt == max_attempts:
            break
        bad = F.col("verdict") != "ok"
        errors = verdicts.filter(bad).groupBy(*keys).agg(F.min_by(
            validation_error(F.col("verdict"), F.col("q_doc_id"), F.col("q_text")), "qidx").alias("error"))
        rejected = checked.filter(~F.col("valid")).join(errors, keys, "left")
        retry = F.array(F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content")),
                        F.struct(F.lit("user").alias("role"), F.concat(F.lit("Validation error: "), F.col("error"),
                                                                       F.lit(RETRY_REQUEST)).alias("content")))
        pending = checkpointed(rejected.withColumn("messages", F.when(
            F.col("parse_ok"), F.concat("messages", retry)).otherwise(F.col("messages")))
            .select(*keys, "rank", "prompt_tokens", "messages"))
        if pending.isEmpty():
            break
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def extractive_answer() -> Answer:
    """A callable that answers from the prompt alone, without a model.

    Theme name: the terms in most representatives (ties by term). Quotes: the
    first sentence of the first representatives, shortened to ``QUOTE_CHARS``
    characters and an ellipsis, as summaries do; whole once a validation error
    asks for it. Action: by the rating of the nearest representative. Its
    completion tokens are a quarter of the characters written.
    """
    quoted, chars, actions = QUOTED, QUOTE_CHARS, dict(SENTIMENT_ACTIONS)

    def answer(prompts):
        import json
        import re
        from collections import Counter
        block = re.compile(r"\[doc_id: (\S+) \| Rating: (\d+)/5\]\n(.*?)\n(?=\n---\n\[doc_id: |\Z)", re.S)
        out = []
        for messages in prompts:
            found = block.findall(messages[1]["content"])
            retried = len(messages) > 2
            terms = Counter(t for _, _, text in found for t in set(re.findall("[a-z]{4,}", text.lower())))
            best = sorted(terms, key=lambda t: (-terms[t], t))[:3]
            quotes = []
            for doc_id, rating, text in found[:quoted]:
                parts = [s.strip(" ") for s in re.findall(r"[^.!?\n]+[.!?]*", text)]
                first = next((s for s in parts if s), "")
                if len(first) > chars and not retried:
                    first = first[:chars].rstrip(" ") + "…"
                quotes.append({"text": first, "doc_id": doc_id, "rating": int(rating)})
            ratings = [int(r) for _, r, _ in found]
            if not found:
                out.append((json.dumps({}), 0))
                continue
            about = f"{len(found)} representative reviews, rated {min(ratings)} to {max(ratings)} of 5."
            sentiment = "pos" if ratings[0] >= 4 else "neg" if ratings[0] <= 2 else "neu"
            theme = {"theme_name": " / ".join(best) or None, "description": about, "quotes": quotes,
                     "action_ideas": [{"title": actions[sentiment], "detail": f"Start with {found[0][0]}."}]}
            written = len(theme["theme_name"] or "") + len(about) + sum(len(q["text"]) for q in quotes)
            out.append((json.dumps(theme, ensure_ascii=False), -(-written // 4)))
        return out
    return answer


ROUNDS_SQL = f"""
, rterm AS (
  SELECT product, cluster_id, term, count(*) AS n
  FROM (SELECT product, cluster_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}'))) AS term FROM rreps)
  GROUP BY ALL
),
rname AS (
  SELECT product, cluster_id, string_agg(term, ' / ' ORDER BY place) AS theme_name
  FROM (SELECT *, row_number() OVER (PARTITION BY product, cluster_id ORDER BY n DESC, term) AS place FROM rterm)
  WHERE place <= 3 GROUP BY ALL
),
rmeta AS (
  SELECT product, cluster_id, arg_min(rating, rank) AS r1,
         count(*) || ' representative reviews, rated ' || min(rating) || ' to ' || max(rating) || ' of 5.' AS description,
         'Start with ' || arg_min(doc_id, rank) || '.' AS detail
  FROM rreps GROUP BY ALL
),
rsent AS (
  SELECT product, cluster_id, rank - 1 AS qidx, doc_id, rating, text, coalesce(list_filter(list_transform(
           regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda s: trim(s)), lambda s: length(s) > 0)[1], '') AS whole
  FROM rreps WHERE rank <= {QUOTED}
),
tquotes AS (
  SELECT product, cluster_id, attempt, qidx, doc_id AS q_doc_id, rating AS q_rating, text,
         CASE WHEN attempt = 1 AND length(whole) > {QUOTE_CHARS} THEN rtrim(substring(whole, 1, {QUOTE_CHARS})) || '…' ELSE whole END AS q_text
  FROM rsent, range(1, 3) a(attempt)
),
tatt AS (
  SELECT product, cluster_id, attempt, bool_and(contains(text, q_text)) AS valid, sum(length(q_text)) AS written
  FROM tquotes GROUP BY ALL
),
tres AS (
  SELECT k.product, k.cluster_id, k.rank, a.attempt, true AS parse_ok, a.valid, theme_name, description, detail,
         CASE WHEN r1 >= 4 THEN '{SENTIMENT_ACTIONS["pos"]}' WHEN r1 <= 2 THEN '{SENTIMENT_ACTIONS["neg"]}' ELSE '{SENTIMENT_ACTIONS["neu"]}' END AS title,
         CAST(ceil((coalesce(length(theme_name), 0) + length(description) + written) / 4) AS BIGINT) AS completion_tokens,
         CASE WHEN a.valid THEN NULL ELSE 'not_verbatim' END AS reason, true AS performed,
         a.valid AS final, CASE WHEN a.valid THEN 'theme' END AS outcome, CASE WHEN a.valid THEN true END AS keep_quotes
  FROM ranked k JOIN tatt a USING (product, cluster_id) JOIN rmeta USING (product, cluster_id) LEFT JOIN rname USING (product, cluster_id)
  WHERE a.attempt = 1 OR NOT (SELECT f.valid FROM tatt f WHERE f.product = k.product AND f.cluster_id = k.cluster_id AND f.attempt = 1)
)"""
