"""The composed training table, and decisions from maps of log probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill import fixed_values as fixed
from tracemill.functions.arrays import join_items
from tracemill.operators import decisions, training
from tracemill.operators.vocabulary import build_vocabulary
from tracemill.plans import views
from tracemill.plans.registry import query, round_all
from tracemill.plans.sql_views import TOKENS_OF
from tracemill.plans.text_queries import assistant_sql, chat_sql
from tracemill.plans.views import PAD_ID

TRAINING_LENGTH = 512

EXAMPLES = f"""SELECT doc_id, lang, {chat_sql(assistant_sql('state', 'completion'))} AS response,
    length({chat_sql(assistant_sql('state', 'state'))}) - {fixed.END_OF_TURN_LENGTH} AS cutoff
    FROM (SELECT doc_id, lang, substr(text, 1, length(text) // 8) AS state, text || '{fixed.FENCE}' AS completion
          FROM documents)"""
PLACED = f"""SELECT doc_id, cutoff, token, pos, sum(length(token)) OVER (PARTITION BY doc_id ORDER BY pos) AS end_at
    FROM (SELECT doc_id, cutoff, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos
          FROM (SELECT doc_id, cutoff, {TOKENS_OF.format('response')} AS toks FROM examples))"""
KNOWN = "SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM placed GROUP BY token"
LABELLED = f"""SELECT doc_id, pos, id, token, end_at, cutoff < end_at - 1 AS kept
    FROM placed JOIN known USING (token) WHERE pos <= {TRAINING_LENGTH}"""
ROWS = f"""SELECT doc_id, list(id ORDER BY pos) AS ids,
    list(CASE WHEN kept THEN id ELSE {fixed.IGNORED_LABEL} END ORDER BY pos) AS labels,
    min(end_at - length(token)) FILTER (kept) AS start
    FROM labelled GROUP BY doc_id"""


def table_sql(length: str, columns: str, where: str = "") -> str:
    return f"SELECT {columns} FROM rows JOIN examples USING (doc_id) {where}".replace("LENGTH", length)


STATE = r"""CASE WHEN contains(response[1:start], '```python' || chr(10))
    THEN regexp_extract(response[1:start], '(?s).*```python\n(.*)', 1) END AS state"""
PADDED = f"""array_to_string(list_resize(ids, LENGTH, {PAD_ID}), ',') AS input_ids,
    array_to_string(list_resize(labels, LENGTH, {fixed.IGNORED_LABEL}), ',') AS labels,
    array_to_string(list_resize([1 for x in ids], LENGTH, 0), ',') AS attention_mask"""


def formatted(spark, sf):
    """Examples with their chats, and the vocabulary of those chats."""
    rows = training.format_examples(views.training_examples(spark, sf))
    return rows, build_vocabulary(training.response_tokens(rows))


@query(
    "training_table_t17",
    table_sql(str(TRAINING_LENGTH), f"doc_id, lang, {STATE}, {PADDED}", "WHERE start IS NOT NULL"),
    examples=EXAMPLES,
    placed=PLACED,
    known=KNOWN,
    labelled=LABELLED,
    rows=ROWS,
)
def training_table(spark, sf):
    """Documents to rows of 512 tokens; states that fill those are thrown out."""
    rows, vocabulary = formatted(spark, sf)
    made = training.training_table(rows, vocabulary, ["doc_id"], PAD_ID, TRAINING_LENGTH, own_texts=True)
    arrays = ("input_ids", "labels", "attention_mask")
    return made.select("doc_id", "lang", "state", *[join_items(F.col(name)).alias(name) for name in arrays])


@query(
    "throwouts_t17",
    "SELECT doc_id, len(ids)::INT AS n_tokens, start IS NULL AS throwout FROM rows",
    examples=EXAMPLES,
    placed=PLACED,
    known=KNOWN,
    labelled=LABELLED,
    rows=ROWS,
)
def throwouts(spark, sf):
    """All examples with their tokens within the length, and whether they are to be thrown out."""
    rows, vocabulary = formatted(spark, sf)
    made = training.tokenize_examples(rows, vocabulary, ["doc_id"], PAD_ID, TRAINING_LENGTH, own_texts=True)
    used = F.size(F.filter("attention_mask", lambda x: x == 1))
    return made.select("doc_id", used.alias("n_tokens"), "throwout")


@query(
    "decision_from_logprobs_d1",
    """SELECT user_id, day, CASE WHEN a >= r AND a >= f THEN 'accept' WHEN r >= f THEN 'reject' ELSE 'finish' END AS action,
              round(a / (a + r + f), 6) AS accept_prob, round(ln(greatest(a, r, f)), 6) AS logprob
       FROM (SELECT user_id, day, a, CASE WHEN a = 0 AND r = 0 AND f = 0 THEN 1 ELSE r END AS r, f FROM (
         SELECT user_id, day, coalesce(sum(exp(logprob)) FILTER (word = 'accept'), 0) AS a,
           coalesce(sum(exp(logprob)) FILTER (word = 'reject'), 0) AS r,
           coalesce(sum(exp(logprob)) FILTER (word = 'finish'), 0) AS f
         FROM (SELECT user_id, day, lower(trim(token_text)) AS word, max(logprob) AS logprob FROM v_decision
               WHERE token_text IS NOT NULL GROUP BY user_id, day, token_text) GROUP BY user_id, day))""",
)
def decision_from_logprobs(spark, sf):
    """The decision of every user and day from a map of vocabulary ids to log probabilities."""
    maps, vocabulary = views.logprob_maps(spark, sf)
    return round_all(decisions.decide_from_logprobs(maps, vocabulary, ["user_id", "day"]))
