"""DuckDB SQL for the queries that SQL can express, on views named like the tables."""

ORACLE_SQL = {
    "op8_chat": """
        WITH t AS (
            SELECT DISTINCT conv_id, turn, CAST(floor(turn / 64.0) AS BIGINT) AS part,
                trim(regexp_replace(coalesce(role, 'unknown'), '[\\s<>|]+', ' ', 'g')) AS speaker,
                replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' AS body
            FROM conversations),
        sp AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
        p AS (
            SELECT DISTINCT t.conv_id, t.part, sp.perspective
            FROM t JOIN sp ON t.conv_id IS NOT DISTINCT FROM sp.conv_id),
        m AS (
            SELECT p.conv_id, p.part, p.perspective, t.turn, t.body, t.speaker = p.perspective AS trained,
                '<|im_start|>' || CASE WHEN t.speaker = 'system' THEN 'system'
                    WHEN t.speaker = p.perspective THEN 'assistant' ELSE 'user name=' || t.speaker END || chr(10) AS head
            FROM p JOIN t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.part IS NOT DISTINCT FROM p.part),
        s AS (
            SELECT *, sum(length(head) + length(body) + 1) OVER (
                PARTITION BY conv_id, part, perspective ORDER BY turn) - length(body) - 1 AS start FROM m)
        SELECT conv_id, part, perspective, count(*) AS n_turns, count(*) FILTER (trained) AS n_trained,
            string_agg(head || body || chr(10), '' ORDER BY turn) AS text,
            coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(start + length(body) AS BIGINT) AS VARCHAR),
                ',' ORDER BY turn) FILTER (trained), '') AS spans
        FROM s GROUP BY conv_id, part, perspective
    """,
    "op9_lm_score": """
        WITH l AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\v\\f\\r]+') AS l FROM documents),
        t AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS w FROM l),
        tot AS (SELECT count(*) AS tokens FROM t),
        uv AS (SELECT w, count(*) AS n FROM t GROUP BY w),
        b AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM t),
        own AS (SELECT doc_id, p, w, count(*) AS c FROM b WHERE p IS NOT NULL GROUP BY doc_id, p, w),
        n12 AS (SELECT p, w, sum(c) AS n FROM own GROUP BY p, w),
        s AS (
            SELECT own.doc_id, own.c AS t,
                own.c * CASE WHEN n12.n > own.c THEN ln((n12.n - own.c) / f.n) ELSE ln(0.4 * g.n / tot.tokens) END AS v
            FROM own JOIN n12 USING (p, w) JOIN uv AS f ON f.w = own.p JOIN uv AS g ON g.w = own.w, tot
            UNION ALL SELECT b.doc_id, 1, ln(uv.n / tot.tokens) FROM b JOIN uv USING (w), tot WHERE b.i = 0
            UNION ALL SELECT doc_id, 0, 0 FROM documents)
        SELECT doc_id, CAST(sum(t) AS BIGINT) AS n_tokens, round(sum(v), 4) AS log_score,
            round(CASE WHEN sum(t) > 0 THEN sum(v) / sum(t) END, 6) AS mean_score
        FROM s GROUP BY doc_id
    """,
}
