"""Decisions, futures, scores and sample weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill import fixed_values as fixed
from tracemill.functions.arrays import join_items, whole_div
from tracemill.functions.tokens import (
    agreement_cut,
    append_sampled_ids,
    last_non_eos_index,
    unpad,
)
from tracemill.operators import completions, decisions
from tracemill.operators.vocabulary import decode
from tracemill.plans import views
from tracemill.plans.registry import query, round_all
from tracemill.plans.views import EOS_ID, SEED

# ------------------------------------------------------------------- decisions

SUMS = """SELECT user_id, day,
    coalesce(sum(exp(logprob)) FILTER (word = 'accept'), 0) AS a,
    coalesce(sum(exp(logprob)) FILTER (word = 'reject'), 0) AS r,
    coalesce(sum(exp(logprob)) FILTER (word = 'finish'), 0) AS f
    FROM (SELECT *, lower(trim(token_text)) AS word FROM v_decision) GROUP BY user_id, day"""
SETTLED = "SELECT user_id, day, a, CASE WHEN a = 0 AND r = 0 AND f = 0 THEN 1 ELSE r END AS r, f FROM sums"


@query(
    "acceptor_decision_d1",
    """SELECT user_id, day, CASE WHEN a >= r AND a >= f THEN 'accept' WHEN r >= f THEN 'reject' ELSE 'finish' END
       AS action FROM settled""",
    sums=SUMS,
    settled=SETTLED,
)
def acceptor_decision(spark, sf):
    return decisions.decide(views.decision_tokens(spark, sf), ["user_id", "day"]).select("user_id", "day", "action")


@query(
    "accept_probability_d2",
    """SELECT user_id, day, round(a / (a + r + f), 6) AS accept_prob, round(ln(greatest(a, r, f)), 6) AS logprob
       FROM settled""",
    sums=SUMS,
    settled=SETTLED,
)
def accept_probability(spark, sf):
    decided = decisions.decide(views.decision_tokens(spark, sf), ["user_id", "day"])
    return round_all(decided.select("user_id", "day", "accept_prob", "logprob"))


# --------------------------------------------------------------------- futures

@query(
    "unravel_futures_j6",
    "SELECT example_id, future, array_to_string(completion_ids, ',') AS completion_ids FROM v_future_rows",
)
def unravel_futures(spark, sf):
    rows = completions.unravel_futures(views.futures(spark, sf))
    return rows.select("example_id", "future", join_items(F.col("completion_ids")).alias("completion_ids"))


@query(
    "agreement_cut_t9",
    """SELECT example_id, array_to_string(code_ids[1:label + 20], ',') AS kept_ids,
              array_to_string(code_ids, ',') AS kept_full FROM v_futures""",
)
def agreement(spark, sf):
    """Cut where the other code leaves; against itself the whole code agrees."""
    state = unpad(F.col("state_ids"), EOS_ID)
    return views.futures(spark, sf).select(
        "example_id",
        join_items(agreement_cut(state, F.col("code_ids"), F.col("null_ids"))).alias("kept_ids"),
        join_items(
            agreement_cut(state, F.col("code_ids"), F.array("code_ids"), full_on_agreement=True)
        ).alias("kept_full"),
    )


@query("last_token_index_t11", "SELECT example_id, held - 1 AS last_index FROM v_futures")
def last_token_index(spark, sf):
    return views.futures(spark, sf).select(
        "example_id", last_non_eos_index(F.col("state_ids"), EOS_ID).alias("last_index")
    )


@query(
    "append_sampled_t20",
    "SELECT example_id, array_to_string(range(1, held + 1) || null_code, ',') AS appended_ids FROM v_futures",
)
def append_sampled(spark, sf):
    """Each step's map lists the sampled id first, then a runner-up."""
    maps = F.transform(
        F.get("null_ids", F.lit(0)), lambda x: F.create_map(x, F.lit(-0.1), x + 5000, F.lit(-2.0))
    )
    state = unpad(F.col("state_ids"), EOS_ID)
    return views.futures(spark, sf).select(
        "example_id", join_items(append_sampled_ids(state, maps)).alias("appended_ids")
    )


@query(
    "state_value_a16",
    """SELECT example_id, round((SELECT avg(x::DOUBLE) FROM (SELECT unnest(q) AS x)), 6) AS state_value
       FROM v_futures""",
)
def state_value(spark, sf):
    value = completions.matrix_mean(F.col("q"))
    return round_all(views.futures(spark, sf).select("example_id", value.alias("state_value")))


def chosen(spark, sf, chooser, longest=32):
    rows = completions.unravel_futures(views.futures(spark, sf))
    return completions.choose_completions(rows, chooser, EOS_ID, seed=SEED, longest=longest)


DRAWN = f"""('0x' || substr(md5(concat_ws('|', example_id::VARCHAR, future::VARCHAR, '{SEED}')), 1, 8))::BIGINT % 32"""
CHOICES = {
    "empowerment": ("held + 1 + best", "score_q", "score_v"),
    "longest": ("held + 32", "0.0::DOUBLE", "score_v"),
    "random": (f"held + 1 + {DRAWN}", f"q[32 * future + {DRAWN} + 1]::DOUBLE", "score_v"),
    "longest_random": (f"held + 1 + {DRAWN}", f"-({DRAWN})::DOUBLE", "0.0::DOUBLE"),
    "shortest": ("held + 1", "0.0::DOUBLE", "score_v"),
}


def choice_sql(chooser: str) -> str:
    length, q, v = CHOICES[chooser]
    return f"""SELECT example_id, future, array_to_string(completion_ids[1:{length}], ',') AS chosen_ids,
        round({q}, 6) AS score_q, round({v}, 6) AS score_v, round({q} - {v}, 6) AS score_a
        FROM (SELECT b.*, r.q FROM v_best b JOIN v_future_rows r USING (example_id, future))"""


def register_chooser(chooser: str) -> None:
    @query(f"choose_{chooser}_t10", choice_sql(chooser))
    def choose(spark, sf):
        columns = ["example_id", "future", join_items(F.col("chosen_ids")).alias("chosen_ids")]
        return round_all(chosen(spark, sf, chooser).select(*columns, "score_q", "score_v", "score_a"))


for _chooser in completions.CHOOSERS:
    register_chooser(_chooser)


@query(
    "chosen_text_t10",
    """SELECT example_id, future, string_agg(token, '' ORDER BY i) || '```' AS correct_completion
       FROM (SELECT example_id, future, unnest(kept) AS id, generate_subscripts(kept, 1) AS i
             FROM (SELECT *, completion_ids[1:held + 1 + best] AS kept FROM v_best))
       LEFT JOIN v_vocab USING (id) GROUP BY example_id, future""",
)
def chosen_text(spark, sf):
    keys = ["example_id", "future"]
    rows = chosen(spark, sf, "empowerment")
    text = decode(rows, keys, "chosen_ids", views.vocabulary(spark, sf), special_ids=[EOS_ID])
    return text.select(*keys, F.concat("text", F.lit(fixed.FENCE)).alias("correct_completion"))


# --------------------------------------------------------------------- weights

STATS = "SELECT avg(score_a) AS m, stddev_samp(score_a) AS s FROM v_best WHERE split = 'train'"


@query("advantage_stats_a15", "SELECT round(m, 6) AS advantage_mean, round(s, 6) AS advantage_std FROM stats", stats=STATS)
def advantage_stats(spark, sf):
    return round_all(completions.advantage_statistics(chosen(spark, sf, "empowerment")))


def weights(spark, sf, strategy):
    weighted = completions.sample_weights(chosen(spark, sf, "empowerment"), strategy, temperature=0.5)
    return round_all(weighted.select("example_id", "future", "weight"))


@query(
    "weights_awr_d4",
    """SELECT example_id, future, round(greatest(least(exp((score_a - m) / (s * 0.5)), 100), 0.01), 6) AS weight
       FROM v_best, stats""",
    stats=STATS,
)
def weights_awr(spark, sf):
    return weights(spark, sf, "awr")


@query(
    "weights_wbc_d5",
    "SELECT example_id, future, round((score_a - m) / (s * 0.5), 6) AS weight FROM v_best, stats",
    stats=STATS,
)
def weights_wbc(spark, sf):
    return weights(spark, sf, "wbc")


@query("weights_even_d6", "SELECT example_id, future, 1.0::DOUBLE AS weight FROM v_best")
def weights_even(spark, sf):
    return weights(spark, sf, "even")


# --------------------------------------------------------------- probabilities

PROBS = """SELECT example_id, pos + 1 AS pos, next_id AS token_id,
    exp(logits[next_id + 1]::DOUBLE) / (SELECT sum(exp(x::DOUBLE)) FROM (SELECT unnest(logits) AS x)) AS prob
    FROM (SELECT *, lead(token_id) OVER (PARTITION BY example_id ORDER BY pos) AS next_id FROM v_logits)
    WHERE next_id IS NOT NULL"""


@query(
    "next_token_prob_t4",
    """SELECT p.example_id, p.pos, token_id, round(prob, 6) AS prob FROM probs p
       JOIN (SELECT example_id, count(*) AS n FROM v_logits GROUP BY example_id) USING (example_id)
       WHERE p.pos >= n // 3""",
    probs=PROBS,
)
def next_token_prob(spark, sf):
    """Probabilities of each sequence's tokens past its state, which is its first third."""
    rows = views.logits(spark, sf)
    lengths = rows.groupBy("example_id").agg(F.count("*").alias("n_tokens"))
    lengths = lengths.withColumn("remaining", F.col("n_tokens") - whole_div(F.col("n_tokens"), 3))
    return round_all(completions.next_token_probabilities(rows, ["example_id"], lengths=lengths))
