"""The views of ``views`` in SQL, for checking queries on a second engine."""

from __future__ import annotations

import re

from tracemill.functions.tokens import TOKEN
from tracemill.plans.views import CONTEST_DATE

#: A text's tokens; their pattern reads the same in both engines.
TOKENS_OF = f"regexp_extract_all({{}}, '{TOKEN}')"

VIEWS: dict[str, str] = {
    "v_raw": """
        SELECT doc_id AS ordinal, doc_id % 40 AS "contestId", lang AS "index", source AS name,
               CASE WHEN doc_id % 17 <> 0 THEN n_chars END AS rating,
               text AS "problem-description", lang AS "input-specification",
               source AS "output-specification",
               CASE WHEN doc_id % 5 <> 0 THEN 'train' ELSE 'test' END AS split
        FROM documents""",
    "v_dedup": """
        SELECT * FROM v_raw
        QUALIFY row_number() OVER (PARTITION BY "contestId", "index" ORDER BY ordinal) = 1""",
    "v_problems": f"""
        SELECT name AS question_title,
               "problem-description" || "input-specification" || "output-specification" AS question_content,
               'codeforces' AS platform, "index" AS question_id, "contestId"::VARCHAR AS contest_id,
               '{CONTEST_DATE}' AS contest_date,
               CASE WHEN "contestId" % 2 = 1 THEN 'def solve():' ELSE '' END AS starter_code,
               CASE WHEN rating < 1000 THEN 'easy' WHEN rating < 2000 THEN 'medium' ELSE 'hard' END AS difficulty,
               '[]' AS public_test_cases, '[]' AS private_test_cases, '[]' AS metadata
        FROM v_dedup""",
    "v_turns": """
        SELECT conv_id, 0::BIGINT AS run_id, turn AS step, text,
               lag(text, 1) OVER w AS one_back, lag(text, 2) OVER w AS two_back
        FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "v_traj": """
        SELECT run_id, 0 AS future, conv_id AS episode_id, step,
               (conv_id % 40)::VARCHAR AS contest_id,
               ['de', 'en', 'es', 'fr'][(conv_id // 40) % 4 + 1] AS question_id,
               code, CASE WHEN step % 3 = 1 THEN code || text END AS suggested_completion
        FROM (SELECT *, string_agg(
                  CASE WHEN step % 3 = 0 THEN
                       (CASE WHEN conv_id % 3 = 1 AND step > 0 THEN coalesce(two_back, '') ELSE '' END) || text
                       WHEN step % 3 = 2 AND conv_id % 3 = 0 THEN coalesce(one_back, '')
                       ELSE '' END, '')
                  OVER (PARTITION BY conv_id, run_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS code
              FROM v_turns)""",
    "v_forked": """
        SELECT run_id, (episode_id % 3)::INT AS future, episode_id // 3 AS episode_id, step, code, suggested_completion
        FROM v_traj""",
    "v_runs": """
        SELECT episode_id // 10 AS run_id, future, episode_id, step, code, suggested_completion FROM v_forked""",
    "v_run_grades": """
        SELECT DISTINCT run_id, future, episode_id, coalesce(quality::DOUBLE, 0.5) AS grade
        FROM v_runs LEFT JOIN labels ON doc_id = 3 * episode_id + future""",
    "v_actions": """
        SELECT 0::BIGINT AS run_id, 0 AS future, conv_id AS episode_id, turn AS step,
               text AS reasoning, 1.0::DOUBLE / (1 + length(text)) AS accept_prob,
               CASE conv_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'finish' END AS action,
               ln(1.0::DOUBLE / (1 + length(text))) AS logprob
        FROM conversations WHERE turn % 3 = 2""",
    "v_results": """
        SELECT doc_id AS episode_id, quality::DOUBLE AS "pass@1" FROM labels""",
    "v_steps": """
        SELECT t.*, a.action, a.reasoning,
               lag(code, 1) OVER e AS code_1, lag(code, 2) OVER e AS code_2,
               lag(suggested_completion, 2) OVER e AS suggestion_2,
               lag(action, 1) OVER e AS action_1, lag(reasoning, 1) OVER e AS reasoning_1
        FROM v_traj t LEFT JOIN v_actions a USING (run_id, future, episode_id, step)
        WINDOW e AS (PARTITION BY run_id, future, episode_id ORDER BY step)""",
    "v_stops": """
        SELECT *, CASE WHEN step % 3 = 2 AND action = 'finish' THEN 1
                       WHEN step % 3 = 0 AND step > 0 AND code = code_1 THEN 1 ELSE 0 END AS stop
        FROM v_steps""",
    "v_activity": """
        SELECT *, coalesce(max(stop) OVER (
                      PARTITION BY run_id, future, episode_id ORDER BY step
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS active
        FROM v_stops""",
    "v_words": f"""
        SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos
        FROM (SELECT doc_id, {TOKENS_OF.format('text')} AS toks
              FROM documents)""",
    "v_vocab": """
        SELECT token, count(*) AS frequency,
               (row_number() OVER (ORDER BY count(*) DESC, token))::INT AS id
        FROM v_words GROUP BY token""",
    "v_ids": """
        SELECT doc_id, pos, token, id FROM v_words JOIN v_vocab USING (token)""",
    "v_tokens": """
        SELECT doc_id, ids, tokens, ids[1:len(ids) // 3] AS state_ids
        FROM (SELECT d.doc_id, coalesce(i.ids, []) AS ids, coalesce(i.tokens, []) AS tokens
              FROM documents d
              LEFT JOIN (SELECT doc_id, list(id ORDER BY pos) AS ids, list(token ORDER BY pos) AS tokens
                         FROM v_ids GROUP BY doc_id) i USING (doc_id))""",
    "v_tokprob": """
        SELECT doc_id, pos - n // 3 AS pos, id, token, n // 3 AS state_size,
               1.0::DOUBLE - 1.0::DOUBLE / (8 * length(token) + (pos - n // 3) + 2) AS prob
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM v_ids)
        WHERE pos >= n // 3""",
    "v_logits": """
        SELECT vec_id // 10 AS example_id, vec_id % 10 AS pos, label AS token_id, embedding AS logits
        FROM embeddings""",
    "v_futures": """
        SELECT vec_id AS example_id, CASE WHEN vec_id % 5 <> 0 THEN 'train' ELSE 'test' END AS split,
               label, (label + 8)::INT AS held, embedding AS q, range(1, 65) AS code_ids,
               [CASE WHEN x = label + 21 THEN x + 1000 ELSE x END for x in range(1, 65)] AS null_code
        FROM embeddings""",
    "v_future_rows": """
        SELECT example_id, split, held, q, 0 AS future, code_ids AS completion_ids FROM v_futures
        UNION ALL
        SELECT example_id, split, held, q, 1 AS future, null_code AS completion_ids FROM v_futures""",
    "v_best": """
        SELECT example_id, split, held, future, completion_ids, h AS best, x::DOUBLE AS score_q, score_v,
               x::DOUBLE - score_v AS score_a
        FROM (SELECT r.*, h, q[32 * future + h + 1] AS x,
                     (SELECT avg(y::DOUBLE) FROM (SELECT unnest(q) AS y)) AS score_v
              FROM v_future_rows r, range(0, 32) t(h))
        QUALIFY row_number() OVER (PARTITION BY example_id, future ORDER BY x DESC, h) = 1""",
    "v_decision": """
        SELECT user_id, ts::DATE::VARCHAR AS day,
               CASE event_type WHEN 'purchase' THEN ' Accept' WHEN 'click' THEN 'accept'
                    WHEN 'view' THEN 'reject ' WHEN 'signup' THEN 'Finish' WHEN 'error' THEN 'other' END AS token_text,
               -value / 50 AS logprob
        FROM events""",
    "v_sft": """
        SELECT doc_id, ids[1:n // 4] AS prompt_ids, ids[n // 4 + 1:2 * (n // 4)] AS state_ids,
               ids[n // 4 + 1:] AS completion_ids
        FROM (SELECT doc_id, ids, len(ids) AS n FROM v_tokens)""",
    "v_sft_ids": """
        SELECT doc_id, len(prompt_ids) + len(state_ids) AS masked,
               prompt_ids || completion_ids || [-1, 0] AS ids
        FROM v_sft""",
    "v_offset_tokens": """
        SELECT doc_id, pos, token, id,
               sum(length(token)) OVER (PARTITION BY doc_id ORDER BY pos) AS end_at
        FROM (SELECT doc_id, pos + 2 AS pos, token, id FROM v_ids
              UNION ALL SELECT doc_id, 0, '```python' || chr(10) || 'seed```', -1 FROM documents
              UNION ALL SELECT doc_id, 1, '```python' || chr(10), -2 FROM documents)""",
    "v_prompts": """
        SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN whole || '<|eot_id|>'
                            ELSE substr(whole, 1, length(whole) // 2) END AS state_prompt
        FROM (SELECT doc_id, string_agg(token, '' ORDER BY pos) AS whole FROM v_offset_tokens GROUP BY doc_id)""",
    "v_offsets": """
        SELECT *, length(state_prompt) AS state_length
        FROM v_offset_tokens JOIN v_prompts USING (doc_id)""",
    "v_kept": """
        SELECT doc_id, pos, token, id, state_prompt, state_length - 10 < end_at - 1 AS kept,
               min(CASE WHEN state_length - 10 < end_at - 1 THEN pos END) OVER (PARTITION BY doc_id) AS first_kept
        FROM v_offsets""",
    "v_snippets": """
        SELECT conv_id, turn,
               CASE conv_id % 4 WHEN 1 THEN '```python' || chr(10) || text || '```'
                    WHEN 2 THEN '```' || chr(10) || text WHEN 3 THEN text || '```tail' ELSE text END AS snippet
        FROM conversations""",
    "v_chat": """
        SELECT conv_id, turn, role, text FROM conversations""",
}



def with_views(body: str, **local: str) -> str:
    """Prefix a query with the views it uses, in order of their definition."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in needed:
                needed.add(name)
                visit(VIEWS[name])

    visit(body)
    for text in local.values():
        visit(text)
    parts = [f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed]
    parts += [f"{name} AS ({text})" for name, text in local.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fill_sql(template: str, **values: str) -> str:
    """SQL expression for a fixed text with expressions in place of ``{name}``."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [values[p] if i % 2 else quote(p) for i, p in enumerate(parts) if i % 2 or p]
    return "(" + " || ".join(pieces) + ")"
