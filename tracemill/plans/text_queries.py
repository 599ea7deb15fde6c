"""Snippets, prompts, chat rendering and line changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill import fixed_values as fixed
from tracemill.functions import prompts, text
from tracemill.operators import metrics
from tracemill.operators.scale import heavy_keys, skewed_join
from tracemill.plans import views
from tracemill.plans.registry import query
from tracemill.plans.sql_views import fill_sql, quote
from tracemill.schemas import EPISODE_KEY, PROBLEM_KEY

KEYS = "run_id, future, episode_id"


# ------------------------------------------------------------ SQL building blocks

def clean_sql(value: str) -> str:
    bare = f"replace({value}, '```python', '')"
    body = rf"(CASE WHEN regexp_matches({bare}, '^\s*```') THEN substr({bare}, strpos({bare}, '```') + 3) ELSE {bare} END)"
    return f"split_part({body}, '```', 1)"


def chat_sql(turns: list[tuple[str, str]], open_turn: str = "none") -> str:
    parts = [
        f"{quote(fixed.CHAT_HEADER_OPEN + role + fixed.CHAT_HEADER_CLOSE)} || {content}" for role, content in turns
    ]
    joined = f" || {quote(fixed.CHAT_END_OF_TURN)} || ".join(parts)
    tail = {
        "continue": "",
        "none": fixed.CHAT_END_OF_TURN,
        "generate": fixed.CHAT_END_OF_TURN + fixed.CHAT_HEADER_OPEN + "assistant" + fixed.CHAT_HEADER_CLOSE,
    }[open_turn]
    return f"{quote(fixed.CHAT_BEGIN)} || {joined} || {quote(tail)}"


def assistant_sql(code: str, answer: str) -> list[tuple[str, str]]:
    def user(value: str) -> tuple[str, str]:
        return "user", fill_sql(fixed.ASSISTANT_USER, code=value)

    def reply(value: str) -> tuple[str, str]:
        return "assistant", fill_sql(fixed.ASSISTANT_ANSWER, code=value)

    return [
        ("system", quote(fixed.ASSISTANT_SYSTEM)),
        user(quote(fixed.EXAMPLE_ONE_CODE)),
        reply(quote(fixed.EXAMPLE_ONE_ANSWER)),
        user(quote(fixed.EXAMPLE_TWO_CODE)),
        reply(quote(fixed.EXAMPLE_TWO_ANSWER)),
        user(code),
        reply(answer),
    ]


def question_sql(question: str, starter: str) -> str:
    layout = (
        f"CASE WHEN coalesce({starter}, '') <> '' THEN {fill_sql(fixed.QUESTION_WITH_STARTER, starter=starter)} "
        f"ELSE {quote(fixed.QUESTION_WITHOUT_STARTER)} END"
    )
    return f"({fill_sql(fixed.QUESTION_HEAD, question=question)} || {layout} || {quote(fixed.QUESTION_TAIL)})"


# ------------------------------------------------------------------- snippets

@query("clean_snippet_x1", f"SELECT conv_id, turn, {clean_sql('snippet')} AS cleaned FROM v_snippets")
def clean_snippet(spark, sf):
    return views.snippets(spark, sf).select("conv_id", "turn", text.clean_snippet(F.col("snippet")).alias("cleaned"))



@query(
    "strip_suffix_x3",
    f"SELECT conv_id, turn, {fill_sql(fixed.BLIND_CONTINUED, code='text')} AS stripped FROM conversations",
)
def strip_suffix(spark, sf):
    """Every other prompt ends with the closing marker that must go."""
    closing = F.when(F.pmod("turn", F.lit(2)) == 0, fixed.CHAT_END_OF_TURN).otherwise("")
    prompt = F.concat(text.fill(fixed.BLIND_CONTINUED, code=F.col("text")), closing)
    return (
        views.table(spark, sf, "conversations")
        .select("conv_id", "turn", prompt.alias("prompt"))
        .select("conv_id", "turn", text.strip_suffix(F.col("prompt"), fixed.CHAT_END_OF_TURN).alias("stripped"))
    )


@query(
    "assemble_suggestion_x4",
    f"""SELECT conv_id, turn, {clean_sql("('import sys' || chr(10) || snippet)")} AS suggestion FROM v_snippets""",
)
def assemble_suggestion(spark, sf):
    return views.snippets(spark, sf).select(
        "conv_id", "turn", text.assemble_suggestion(F.lit("import sys\n"), F.col("snippet")).alias("suggestion")
    )


@query(
    "normalise_token_x12",
    r"SELECT event_id, lower(trim(' ' || event_type || '  ')) AS token FROM events",
)
def normalise_token(spark, sf):
    padded = F.concat(F.lit(" "), F.initcap("event_type"), F.lit(" \n"))
    return views.table(spark, sf, "events").select("event_id", text.normalise_token(padded).alias("token"))


@query(
    "suggested_tail_x13",
    f"SELECT {KEYS}, step, substr(suggested_completion, length(code) + 1) AS tail FROM v_traj WHERE step % 3 = 1",
)
def suggested_tail(spark, sf):
    return (
        views.trajectories(spark, sf)
        .where(F.pmod("step", F.lit(3)) == 1)
        .select(*EPISODE_KEY, "step", text.suggested_tail(F.col("code"), F.col("suggested_completion")).alias("tail"))
    )


# -------------------------------------------------------------------- prompts

@query(
    "assistant_prompt_x5",
    f"""SELECT conv_id, turn,
        {chat_sql(assistant_sql('text', "CASE WHEN turn % 2 = 0 THEN text ELSE '' END"), 'continue')} AS prompt
        FROM conversations""",
)
def assistant_prompt(spark, sf):
    """Odd turns give an empty answer, even ones none at all."""
    answer = F.when(F.pmod("turn", F.lit(2)) == 1, F.lit(""))
    messages = prompts.assistant_prompt(F.col("text"), answer)
    return views.table(spark, sf, "conversations").select(
        "conv_id", "turn", prompts.render_chat(messages, "continue").alias("prompt")
    )


@query(
    "question_prompt_x6",
    f"SELECT contest_id, question_id, {question_sql('question_content', 'starter_code')} AS question FROM v_problems",
)
def question_prompt(spark, sf):
    return views.problems(spark, sf).select(
        *PROBLEM_KEY, prompts.question_text(F.col("question_content"), F.col("starter_code")).alias("question")
    )


GENERATION = [
    ("system", quote(fixed.GENERATION_SYSTEM)),
    ("user", question_sql("question_content", "starter_code")),
]


@query(
    "generation_prompt_x7",
    f"""SELECT contest_id, question_id, {chat_sql(GENERATION, 'generate')} AS opened,
        {chat_sql(GENERATION + [('assistant', fill_sql(fixed.GENERATION_CONTINUED, code='starter_code'))], 'continue')}
        AS continued FROM v_problems""",
)
def generation_prompt(spark, sf):
    question, starter = F.col("question_content"), F.col("starter_code")
    return views.problems(spark, sf).select(
        *PROBLEM_KEY,
        prompts.render_chat(prompts.generation_prompt(question, starter), "generate").alias("opened"),
        prompts.render_chat(prompts.generation_prompt(question, starter, starter), "continue").alias("continued"),
    )


BLIND = [("system", quote(fixed.BLIND_SYSTEM)), ("user", fill_sql(fixed.BLIND_USER, code="text"))]


@query(
    "blind_prompt_x8",
    f"""SELECT conv_id, turn, {chat_sql(BLIND, 'generate')} AS opened,
        {chat_sql(BLIND + [('assistant', fill_sql(fixed.BLIND_CONTINUED, code='text'))], 'continue')} AS continued
        FROM conversations""",
)
def blind_prompt(spark, sf):
    code = F.col("text")
    return views.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        prompts.render_chat(prompts.blind_prompt(code), "generate").alias("opened"),
        prompts.render_chat(prompts.blind_prompt(code, code), "continue").alias("continued"),
    )


# A running count per distinct line: equal lines pair off, what is left over changed.
BREAKS = r"'\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'"


def lines_sql(value: str) -> str:
    return (
        f"CASE WHEN {value} = '' THEN [] ELSE regexp_split_to_array("
        f"regexp_replace({value}, '(?:' || {BREAKS} || ')$', ''), {BREAKS}) END"
    )


OLD = f"SELECT {KEYS}, step, unnest({lines_sql('code')}) AS line FROM v_traj WHERE step % 3 = 1"
NEW = f"SELECT {KEYS}, step, unnest({lines_sql('suggested_completion')}) AS line FROM v_traj WHERE step % 3 = 1"
CHANGES = f"""SELECT {KEYS}, step,
    coalesce(sum(greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0)), 0)::BIGINT AS added_lines,
    coalesce(sum(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0)), 0)::BIGINT AS removed_lines
    FROM (SELECT {KEYS}, step, line, count(*) AS n FROM old_lines GROUP BY ALL) a
    FULL JOIN (SELECT {KEYS}, step, line, count(*) AS n FROM new_lines GROUP BY ALL) b
    USING ({KEYS}, step, line) GROUP BY ALL"""


def line_changes(spark, sf):
    steps = views.trajectories(spark, sf).where(F.pmod("step", F.lit(3)) == 1)
    keys = [*EPISODE_KEY, "step"]
    return metrics.line_changes(steps, keys, F.col("code"), F.col("suggested_completion"))


@query("line_changes_x11", "SELECT * FROM changes", old_lines=OLD, new_lines=NEW, changes=CHANGES)
def changed_lines(spark, sf):
    return line_changes(spark, sf)


SUMMARY = fill_sql(fixed.CHANGE_SUMMARY, added="added_lines::VARCHAR", removed="removed_lines::VARCHAR")
ACCEPTOR = [
    ("system", quote(fixed.ACCEPTOR_SYSTEM)),
    ("user", question_sql("question_content", "starter_code")),
    ("assistant", fill_sql(fixed.ACCEPTOR_CODE, code="code")),
    ("user", fill_sql(fixed.ACCEPTOR_VIEW, code="code", suggestion="suggested_completion", change=SUMMARY)),
]
FOLLOW_UP = ACCEPTOR + [
    ("assistant", "reasoning"),
    ("user", quote(fixed.ACCEPTOR_FOLLOW_UP)),
    ("assistant", quote(fixed.ACCEPTOR_CONTINUED)),
]


@query(
    "acceptor_prompt_x9",
    f"""SELECT t.run_id, t.future, t.episode_id, t.step, {chat_sql(ACCEPTOR, 'generate')} AS opened,
        {chat_sql(FOLLOW_UP, 'continue')} AS continued
        FROM v_traj t JOIN changes USING ({KEYS}, step)
        JOIN v_problems p USING (contest_id, question_id)
        JOIN v_actions a ON a.run_id = t.run_id AND a.episode_id = t.episode_id AND a.step = t.step + 1""",
    old_lines=OLD,
    new_lines=NEW,
    changes=CHANGES,
)
def acceptor_prompt(spark, sf):
    keys = [*EPISODE_KEY, "step"]
    steps = views.trajectories(spark, sf).where(F.pmod("step", F.lit(3)) == 1)
    reasons = views.infos(spark, sf).select(*EPISODE_KEY, (F.col("step") - 1).alias("step"), "reasoning")
    shown = steps.join(line_changes(spark, sf), keys).join(reasons, keys)
    problems = views.problems(spark, sf).select(*PROBLEM_KEY, "question_content", "starter_code")
    hot = heavy_keys(steps, PROBLEM_KEY)
    rows = skewed_join(shown, problems, PROBLEM_KEY, hot, spread_on=keys)
    change = prompts.change_summary(F.col("added_lines"), F.col("removed_lines"))
    parts = [F.col(name) for name in ("question_content", "starter_code", "code", "suggested_completion")]
    return rows.select(
        *keys,
        prompts.render_chat(prompts.acceptor_prompt(*parts, change), "generate").alias("opened"),
        prompts.render_chat(prompts.acceptor_prompt(*parts, change, F.col("reasoning")), "continue").alias(
            "continued"
        ),
    )


TURN = f"'{fixed.CHAT_HEADER_OPEN}' || role || {quote(fixed.CHAT_HEADER_CLOSE)} || text"


@query(
    "render_chat_x10",
    f"""SELECT conv_id, '{fixed.CHAT_BEGIN}'
        || string_agg({TURN}, '{fixed.CHAT_END_OF_TURN}' ORDER BY turn) || '{fixed.CHAT_END_OF_TURN}' AS rendered
        FROM v_chat GROUP BY conv_id""",
)
def render_chat(spark, sf):
    return views.chats(spark, sf).select(
        "conv_id", prompts.render_chat(F.col("messages")).alias("rendered")
    )
