"""Episode analytics: windows, per-cycle and per-episode metrics, joins and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill import fixed_values as fixed
from tracemill.functions.arrays import join_items
from tracemill.functions.text import strip_prefix
from tracemill.operators import curation, episodes, metrics, quality
from tracemill.operators.scale import first_per_key
from tracemill.plans import views
from tracemill.plans.registry import query, round_all
from tracemill.plans.sql_views import TOKENS_OF
from tracemill.schemas import EPISODE_KEY, PROBLEM_KEY

KEYS = "run_id, future, episode_id"
COUNT_WORDS = f"len({TOKENS_OF})"


def words_sql(text: str) -> str:
    return COUNT_WORDS.format(text)


# ---------------------------------------------------------------- sources

@query("read_trajectories_s4", f"SELECT {KEYS}, step, code, suggested_completion FROM v_traj")
def read_trajectories(spark, sf):
    return views.trajectories(spark, sf).select(*EPISODE_KEY, "step", "code", "suggested_completion")


@query("read_results_s5", 'SELECT episode_id, "pass@1" AS pass_at_1 FROM v_results')
def read_results(spark, sf):
    return views.results(spark, sf).select("episode_id", F.col("`pass@1`").alias("pass_at_1"))


# ---------------------------------------------------------------- windows

@query(
    "phase_labels_w1",
    f"""SELECT {KEYS}, step, CASE WHEN step = 0 THEN 'initial' WHEN step % 3 = 1 THEN 'assistant'
        WHEN step % 3 = 2 THEN 'acceptor' ELSE 'appender' END AS phase FROM v_traj""",
)
def phase_labels(spark, sf):
    return views.trajectories(spark, sf).select(
        *EPISODE_KEY, "step", episodes.phase_of(F.col("step")).alias("phase")
    )


@query(
    "code_growth_w2",
    f"SELECT {KEYS}, step, length(code)::INT AS code_length, (length(code) - length(code_1))::INT AS growth FROM v_steps",
)
def code_growth(spark, sf):
    return episodes.code_growth(views.trajectories(spark, sf))


@query(
    "final_state_w3",
    f"""SELECT {KEYS}, step, code, suggested_completion FROM v_traj
        QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY step DESC) = 1""",
)
def final_state(spark, sf):
    return episodes.latest(views.trajectories(spark, sf), ["code", "suggested_completion"])


@query(
    "latest_info_w4",
    f"""SELECT {KEYS}, step, action, reasoning FROM v_actions
        QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY step DESC) = 1""",
)
def latest_info(spark, sf):
    return episodes.latest(views.infos(spark, sf), ["action", "reasoning"])


@query(
    "states_back_w5",
    f"""SELECT {KEYS}, step, code_1 AS code_1_back, code_2 AS code_2_back, suggestion_2 AS suggestion_2_back
        FROM v_steps""",
)
def states_back(spark, sf):
    return episodes.with_two_back(views.trajectories(spark, sf)).select(
        *EPISODE_KEY, "step", "code_1_back", "code_2_back", "suggestion_2_back"
    )


@query("activity_w6", f"SELECT {KEYS}, step, active FROM v_activity")
def activity(spark, sf):
    return episodes.with_activity(views.trajectories(spark, sf), views.infos(spark, sf)).select(
        *EPISODE_KEY, "step", "active"
    )


# ---------------------------------------------------------------- metrics

@query("pass_rate_a1", 'SELECT round(avg("pass@1"), 6) AS pass_at_1 FROM v_results')
def pass_rate(spark, sf):
    return round_all(metrics.pass_rate(views.results(spark, sf)))


@query(
    "action_ratio_a2",
    "SELECT round((count(*) FILTER (action = 'accept')) / nullif(count(action), 0), 6) AS ratio FROM v_actions",
)
def action_ratio(spark, sf):
    return round_all(metrics.action_ratio(views.infos(spark, sf), "accept"))


def ratios_sql(source: str) -> str:
    columns = ", ".join(
        f"round((count(*) FILTER (action = '{a}')) / nullif(count(action), 0), 6) AS {a}_ratio"
        for a in fixed.RATIO_ACTIONS
    )
    return f"SELECT {columns} FROM {source}"


@query("action_ratios_a3", ratios_sql("v_actions"))
def action_ratios(spark, sf):
    return round_all(metrics.action_ratios(views.infos(spark, sf)))


@query(
    "latest_action_ratios_a3",
    ratios_sql(
        f"(SELECT * FROM v_actions QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY step DESC) = 1)"
    ),
)
def latest_action_ratios(spark, sf):
    return round_all(metrics.latest_action_ratios(views.infos(spark, sf)))


# The latest info of every episode at every cycle, spelled out: one row for each pair.
SPANS = f"SELECT {KEYS}, max(step) FILTER (active) AS last_step FROM v_activity GROUP BY {KEYS}"
LATEST = f"""SELECT s.run_id, s.future, c.cycle, a.action, a.accept_prob, a.logprob
    FROM spans s
    JOIN (SELECT run_id, future, unnest(range(0, max((last_step + 2) // 3))) AS cycle FROM spans GROUP BY run_id, future) c
      USING (run_id, future)
    LEFT JOIN v_actions a ON a.run_id = s.run_id AND a.future = s.future AND a.episode_id = s.episode_id
      AND a.step = least(s.last_step, 3 * c.cycle + 2)"""


@query(
    "cycle_action_ratios_a3",
    "SELECT run_id, future, cycle, count(*) AS episodes, count(action) AS with_action, "
    + ", ".join(
        f"round((count(*) FILTER (action = '{a}')) / nullif(count(action), 0), 6) AS {a}_ratio"
        for a in fixed.RATIO_ACTIONS
    )
    + " FROM latest GROUP BY run_id, future, cycle",
    spans=SPANS,
    latest=LATEST,
)
def cycle_action_ratios(spark, sf):
    return round_all(metrics.action_ratios_per_cycle(views.trajectories(spark, sf), views.infos(spark, sf)))


@query(
    "cycle_numeric_means_a5",
    """SELECT run_id, future, cycle, count(*) AS episodes, round(avg(accept_prob), 6) AS mean_accept_prob,
              round(avg(logprob), 6) AS mean_logprob FROM latest GROUP BY run_id, future, cycle""",
    spans=SPANS,
    latest=LATEST,
)
def cycle_numeric_means(spark, sf):
    return round_all(metrics.numeric_means_per_cycle(views.trajectories(spark, sf), views.infos(spark, sf)))


def sem_sql(value: str, name: str, source: str) -> str:
    return f"""SELECT round(avg({value}), 6) AS mean_{name},
        round(stddev_pop({value}) / nullif(sqrt(count({value})), 0), 6) AS sem_{name},
        count({value}) AS n FROM {source}"""


@query("accept_ratio_a4", sem_sql("(action = 'accept')::INT::DOUBLE", "accept", "(SELECT * FROM v_actions WHERE step = 2)"))
def accept_ratio(spark, sf):
    return round_all(metrics.accept_ratio(views.infos(spark, sf)))


@query(
    "numeric_means_a5",
    "SELECT round(avg(accept_prob), 6) AS mean_accept_prob, round(avg(logprob), 6) AS mean_logprob FROM v_actions",
)
def numeric_means(spark, sf):
    return round_all(metrics.numeric_means(views.infos(spark, sf), skip=[*EPISODE_KEY, "step"]))


@query(
    "action_length_a6",
    sem_sql("added", "action_length", "added"),
    added=f"SELECT ({words_sql('suggested_completion')} - {words_sql('code')})::DOUBLE AS added "
    "FROM v_traj WHERE step = 1 AND future = 0",
)
def action_length(spark, sf):
    return round_all(metrics.action_lengths(views.trajectories(spark, sf)))


@query(
    "suggested_length_a7",
    sem_sql("tokens", "completion_length", "tails"),
    tails=f"SELECT ({words_sql('substr(suggested_completion, length(code) + 1)')})::DOUBLE AS tokens "
    "FROM v_traj WHERE step % 3 = 1",
)
def suggested_length(spark, sf):
    return round_all(metrics.suggested_lengths(views.trajectories(spark, sf)))


@query(
    "final_length_a9",
    f"""SELECT round(avg(length(code)), 6) AS mean_chars, round(stddev_pop(length(code)), 6) AS std_chars
        FROM (SELECT * FROM v_traj QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY step DESC) = 1)""",
)
def final_length(spark, sf):
    return round_all(metrics.final_lengths(views.trajectories(spark, sf)))


TOTALS = f"""SELECT {KEYS},
    coalesce(sum(CASE WHEN step % 3 = 1 THEN length(suggested_completion) - length(code) END), 0)::BIGINT AS suggested_chars,
    coalesce(sum(CASE WHEN step % 3 = 0 AND step > 0 THEN length(code) - length(code_1) END), 0)::BIGINT AS appended_chars,
    max_by(length(code), step)::BIGINT AS final_length
    FROM v_steps GROUP BY ALL"""


@query("character_totals_a10", "SELECT * FROM totals", totals=TOTALS)
def character_totals(spark, sf):
    return episodes.character_totals(views.trajectories(spark, sf)).withColumns(
        {name: F.col(name).cast("long") for name in ("suggested_chars", "appended_chars", "final_length")}
    )


SCORES = f"""SELECT t.*, "pass@1",
    pow({fixed.DISCOUNT_PER_TOKEN}::DOUBLE, {fixed.READING_CHAR_WEIGHT}::DOUBLE * suggested_chars
        + {fixed.WRITING_CHAR_WEIGHT}::DOUBLE * appended_chars) * CASE WHEN "pass@1" = 1 THEN 1 ELSE 0 END AS score
    FROM totals t JOIN v_results USING (episode_id)"""


@query(
    "episode_scores_j4",
    "SELECT run_id, future, episode_id, round(score, 6) AS score FROM scores",
    totals=TOTALS,
    scores=SCORES,
)
def episode_scores(spark, sf):
    scored = metrics.discounted_scores(views.trajectories(spark, sf), views.results(spark, sf))
    return round_all(scored.select(*EPISODE_KEY, "score"))


@query("discounted_pass_rate_a11", "SELECT round(avg(score), 6) AS discounted_pass_rate FROM scores", totals=TOTALS, scores=SCORES)
def discounted_pass_rate(spark, sf):
    rate = metrics.discounted_pass_rate(views.trajectories(spark, sf), views.results(spark, sf))
    return round_all(rate.select(F.col("mean_discounted_pass").alias("discounted_pass_rate")))


@query("discounted_pass_error_a12", sem_sql("score", "discounted_pass", "scores"), totals=TOTALS, scores=SCORES)
def discounted_pass_error(spark, sf):
    return round_all(metrics.discounted_pass_rate(views.trajectories(spark, sf), views.results(spark, sf)))


@query(
    "active_per_cycle_a13",
    """SELECT (step - 1) // 3 AS cycle, count(*) FILTER (step % 3 = 1) AS entered,
              count(*) FILTER (step % 3 = 0 AND stop = 0) AS active
       FROM v_activity WHERE active AND step > 0 GROUP BY 1""",
)
def active_per_cycle(spark, sf):
    return metrics.active_per_cycle(views.trajectories(spark, sf), views.infos(spark, sf))


@query(
    "implicit_acceptance_a14",
    """SELECT c.cycle, round(avg(hit), 6) AS implicit_acceptance_rate
       FROM (SELECT DISTINCT (step - 1) // 3 AS cycle FROM v_activity WHERE active AND step > 0) c
       LEFT JOIN (SELECT (step - 1) // 3 AS cycle,
                         CASE WHEN action_1 <> 'accept' AND starts_with(code, suggestion_2)
                                   AND length(suggestion_2) > length(code_2) THEN 1.0 ELSE 0.0 END AS hit
                  FROM v_activity WHERE active AND stop = 0 AND step > 0 AND step % 3 = 0) h USING (cycle)
       GROUP BY 1""",
)
def implicit_acceptance(spark, sf):
    return round_all(metrics.implicit_acceptance(views.trajectories(spark, sf), views.infos(spark, sf)))


# ------------------------------------------------- joins and transitions

@query(
    "audit_table_p10",
    f"""SELECT {KEYS}, (step - 1) // 3 AS cycle, question_content AS problem, code_2 AS code_before,
               suggestion_2 AS suggestion, action_1 AS action, reasoning_1 AS reasoning, code AS code_after
        FROM v_activity a LEFT JOIN v_problems p USING (contest_id, question_id)
        WHERE active AND stop = 0 AND step > 0 AND step % 3 = 0""",
)
def audit_table(spark, sf):
    return episodes.audit_table(
        views.trajectories(spark, sf), views.infos(spark, sf), views.problems(spark, sf)
    )


def rollout_codes(spark, sf):
    """Final code of the first episode of each problem, every other one with the placeholder line."""
    steps = views.trajectories(spark, sf)
    final = episodes.latest(steps, ["contest_id", "question_id", "code"])
    marked = F.when(
        F.pmod("episode_id", F.lit(2)) == 0, F.concat(F.lit(fixed.CODE_PLACEHOLDER), "code")
    ).otherwise(F.col("code"))
    return first_per_key(final, PROBLEM_KEY, "episode_id").select(*PROBLEM_KEY, marked.alias("code"))


CODES = """SELECT contest_id, question_id, code FROM (
    SELECT * FROM v_traj
    QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY step DESC) = 1)
    QUALIFY row_number() OVER (PARTITION BY contest_id, question_id ORDER BY episode_id) = 1"""


@query(
    "attach_code_j3",
    "SELECT contest_id, question_id, question_title, difficulty, code FROM v_problems LEFT JOIN codes USING (contest_id, question_id)",
    codes=CODES,
)
def attach_code(spark, sf):
    return curation.attach_code(views.problems(spark, sf), rollout_codes(spark, sf)).select(
        *PROBLEM_KEY, "question_title", "difficulty", "code"
    )


@query(
    "unmatched_codes_j3",
    """SELECT count(*) AS checked, count(*) FILTER (p.contest_id IS NULL OR c.contest_id IS NULL) AS violations
       FROM v_problems p FULL JOIN codes c ON p.contest_id = c.contest_id AND p.question_id = c.question_id""",
    codes=CODES,
)
def unmatched_codes(spark, sf):
    return quality.unmatched_codes(views.problems(spark, sf), rollout_codes(spark, sf), list(PROBLEM_KEY))


@query(
    "strip_prefix_x2",
    f"SELECT {KEYS}, step, code AS stripped FROM v_traj",
)
def strip_known_prefix(spark, sf):
    marked = F.when(
        F.pmod("episode_id", F.lit(2)) == 0, F.concat(F.lit(fixed.CODE_PLACEHOLDER), "code")
    ).otherwise(F.col("code"))
    return (
        views.trajectories(spark, sf)
        .withColumn("code", marked)
        .select(*EPISODE_KEY, "step", strip_prefix(F.col("code"), fixed.CODE_PLACEHOLDER).alias("stripped"))
    )


@query(
    "enrich_problems_j5",
    f"""SELECT l.run_id, l.episode_id, f.suggested_completion || '```' AS correct_completion, l.code,
               a.action = 'accept' AS accepted
        FROM (SELECT * FROM v_traj QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY step DESC) = 1) l
        LEFT JOIN v_traj f ON f.run_id = l.run_id AND f.episode_id = l.episode_id AND f.step = 1
        LEFT JOIN v_actions a ON a.run_id = l.run_id AND a.episode_id = l.episode_id AND a.step = 2""",
)
def enrich_problems(spark, sf):
    return episodes.enrich_problems(views.trajectories(spark, sf), views.infos(spark, sf))


@query(
    "enriched_dataset_j5",
    f"""SELECT d.doc_id AS episode_id, d.lang, d.n_chars, s.suggested_completion || '```' AS correct_completion, l.code,
               a.action = 'accept' AS accepted
        FROM documents d
        LEFT JOIN (SELECT * FROM v_traj QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY step DESC) = 1) l
          ON l.episode_id = d.doc_id
        LEFT JOIN v_traj s ON s.episode_id = d.doc_id AND s.step = 1
        LEFT JOIN v_actions a ON a.episode_id = d.doc_id AND a.step = 2""",
)
def enriched_dataset(spark, sf):
    """Documents as the dataset that episodes were rolled out on; what has no episode stays."""
    return episodes.enrich_dataset(
        views.dataset(spark, sf), views.trajectories(spark, sf), views.infos(spark, sf)
    )


LAST_TWO = f"""SELECT * FROM (
    SELECT *, lag(code, 1) OVER e AS code_1, row_number() OVER (PARTITION BY {KEYS} ORDER BY step DESC) AS back
    FROM v_forked WINDOW e AS (PARTITION BY {KEYS} ORDER BY step)) WHERE back = 1"""
NEXT_STATES = f"""SELECT {KEYS}, code,
    array_to_string({TOKENS_OF.format('code')}[1:len({TOKENS_OF.format('code_1')}) + 10], '') AS next_state
    FROM last_two"""


@query(
    "next_state_t19",
    f"SELECT {KEYS}, code, next_state FROM next_states",
    last_two=LAST_TWO,
    next_states=NEXT_STATES,
)
def next_state(spark, sf):
    return episodes.next_states(views.forked_trajectories(spark, sf))


@query(
    "paired_futures_j7",
    """SELECT n.run_id, n.episode_id, f.suggested_completion AS correct_completion,
              string_agg(n.next_state, '|' ORDER BY n.future) AS next_states,
              string_agg(n.code, '|' ORDER BY n.future) AS codes
       FROM next_states n JOIN v_forked f
         ON f.run_id = n.run_id AND f.episode_id = n.episode_id AND f.future = 0 AND f.step = 1
       GROUP BY ALL""",
    last_two=LAST_TWO,
    next_states=NEXT_STATES,
)
def paired_futures(spark, sf):
    return episodes.paired_futures(views.forked_trajectories(spark, sf)).select(
        "run_id",
        "episode_id",
        "correct_completion",
        join_items(F.col("next_state"), "|").alias("next_states"),
        join_items(F.col("code"), "|").alias("codes"),
    )


@query(
    "paired_dataset_j7",
    """SELECT d.doc_id AS episode_id, d.lang, d.n_chars, f.suggested_completion AS correct_completion,
              string_agg(n.next_state, '|' ORDER BY n.future) AS next_states,
              string_agg(n.code, '|' ORDER BY n.future) AS codes
       FROM next_states n
       JOIN v_forked f ON f.run_id = n.run_id AND f.episode_id = n.episode_id AND f.future = 0 AND f.step = 1
       JOIN documents d ON d.doc_id = n.episode_id
       GROUP BY ALL""",
    last_two=LAST_TWO,
    next_states=NEXT_STATES,
)
def paired_dataset(spark, sf):
    return episodes.pair_dataset(views.dataset(spark, sf), views.forked_trajectories(spark, sf)).select(
        "episode_id",
        "lang",
        "n_chars",
        "correct_completion",
        join_items(F.col("next_state"), "|").alias("next_states"),
        join_items(F.col("code"), "|").alias("codes"),
    )


@query(
    "human_transition_j8",
    f"""SELECT {KEYS}, step, new_code AS code, NULL::VARCHAR AS suggested_completion, new_code = code AS done
        FROM (SELECT t.*, CASE WHEN a.action = 'accept' THEN t.suggested_completion ELSE t.code END AS new_code
              FROM v_traj t JOIN v_actions a
                ON a.run_id = t.run_id AND a.episode_id = t.episode_id AND a.step = t.step + 1)""",
)
def human_transition(spark, sf):
    states, actions = decided_actions(spark, sf)
    return episodes.apply_human_actions(states, actions)


def decided_actions(spark, sf):
    """States shown to the acceptor, and the code each decision leads to."""
    states = views.trajectories(spark, sf).where(F.pmod("step", F.lit(3)) == 1)
    infos = views.infos(spark, sf).withColumn("step", F.col("step") - 1)
    actions = states.join(infos.select(*episodes.STEP_KEY, "action"), [*episodes.STEP_KEY]).select(
        *episodes.STEP_KEY,
        episodes.decided_code(F.col("action"), F.col("suggested_completion"), F.col("code")).alias("code"),
    )
    return states, actions


@query(
    "decision_to_code_d3",
    f"""SELECT t.run_id, t.future, t.episode_id, t.step,
               CASE WHEN a.action = 'accept' THEN t.suggested_completion ELSE t.code END AS code
        FROM v_traj t JOIN v_actions a
          ON a.run_id = t.run_id AND a.episode_id = t.episode_id AND a.step = t.step + 1""",
)
def decision_to_code(spark, sf):
    return decided_actions(spark, sf)[1]


@query(
    "assistant_transition_j9",
    f"""SELECT {KEYS}, step, t.code, c.text AS suggested_completion, false AS done
        FROM v_traj t JOIN conversations c
          ON c.conv_id = t.episode_id AND c.turn = t.step""",
)
def assistant_transition(spark, sf):
    actions = views.table(spark, sf, "conversations").select(
        F.lit(0).cast("long").alias("run_id"),
        F.lit(0).alias("future"),
        F.col("conv_id").alias("episode_id"),
        F.col("turn").alias("step"),
        F.col("text").alias("code"),
    )
    return episodes.apply_assistant_actions(views.trajectories(spark, sf), actions)


@query(
    "initial_states_j10",
    "SELECT contest_id, question_id, starter_code AS code, NULL::VARCHAR AS suggested_completion FROM v_problems",
)
def initial_states(spark, sf):
    return episodes.initial_states(views.problems(spark, sf))


@query(
    "fork_futures_j11",
    f"""SELECT run_id, k::INT AS future, episode_id, step, code, suggested_completion
        FROM v_traj, range(0, 4) t(k) WHERE step <= 1""",
)
def fork_futures(spark, sf):
    return episodes.fork_futures(views.trajectories(spark, sf), 4).select(
        *EPISODE_KEY, "step", "code", "suggested_completion"
    )


@query(
    "keep_passed_f4",
    f"""SELECT {KEYS}, step, code FROM v_traj
        WHERE episode_id IN (SELECT episode_id FROM v_results WHERE "pass@1" = 1)""",
)
def keep_passed(spark, sf):
    return episodes.keep_passed(views.trajectories(spark, sf), views.results(spark, sf)).select(
        *EPISODE_KEY, "step", "code"
    )


# ---------------------------------------------------------------- checks

@query(
    "missing_suggestions_q1",
    "SELECT count(*) AS checked, count(*) FILTER (suggested_completion IS NULL) AS violations FROM v_traj WHERE step % 3 = 1",
)
def missing_suggestions(spark, sf):
    return quality.missing_suggestions(views.trajectories(spark, sf))


@query(
    "overlong_appends_q2",
    "SELECT count(*) AS checked, count(*) FILTER (appended_chars > final_length) AS violations FROM totals",
    totals=TOTALS,
)
def overlong_appends(spark, sf):
    return quality.overlong_appends(views.trajectories(spark, sf))


@query(
    "missing_code_ids_q7",
    "SELECT count(*) AS checked, count(*) FILTER (step % 3 <> 0) AS violations FROM v_traj",
)
def missing_code_ids(spark, sf):
    """States after an append carry ids; the others do not."""
    ids = F.when(F.pmod("step", F.lit(3)) == 0, F.array(F.length("code")))
    return quality.missing_code_ids(views.trajectories(spark, sf).withColumn("code_iids", ids))
