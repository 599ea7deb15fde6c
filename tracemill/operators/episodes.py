"""Step-indexed episodes: transitions, phases, per-cycle and per-episode views.

Step 0 is the initial state. Each cycle c then has three steps: 3c+1 after the
assistant, 3c+2 after the acceptor, 3c+3 after the appender. Steps of an
episode have no gaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import fixed_values as fixed
from tracemill.functions.arrays import head, whole_div
from tracemill.functions.tokens import detokenize, token_count, tokenize
from tracemill.operators.curation import drop_derived
from tracemill.operators.scale import heavy_keys, skewed_join, with_group_values, with_previous
from tracemill.schemas import EPISODE_KEY, PROBLEM_KEY

STEP_KEY = (*EPISODE_KEY, "step")


def phase_of(step: Column) -> Column:
    return (
        F.when(step == 0, "initial")
        .when(F.pmod(step, F.lit(3)) == 1, "assistant")
        .when(F.pmod(step, F.lit(3)) == 2, "acceptor")
        .otherwise("appender")
    )


def cycle_of(step: Column) -> Column:
    """Cycle of a step past the initial one."""
    return whole_div(step - 1, 3)


# ------------------------------------------------------------------ transitions

def initial_states(problems: DataFrame) -> DataFrame:
    """One state per problem: its starter code and no suggestion."""
    return problems.select(
        *PROBLEM_KEY,
        F.col("starter_code").alias("code"),
        F.lit(None).cast("string").alias("suggested_completion"),
    )


def apply_human_actions(states: DataFrame, actions: DataFrame) -> DataFrame:
    """New code, suggestion cleared; done when the code did not change."""
    new = actions.select(*STEP_KEY, F.col("code").alias("_new"))
    return states.join(new, [*STEP_KEY]).select(
        *STEP_KEY,
        F.col("_new").alias("code"),
        F.lit(None).cast("string").alias("suggested_completion"),
        (F.col("_new") == F.col("code")).alias("done"),
    )


def apply_assistant_actions(states: DataFrame, actions: DataFrame) -> DataFrame:
    """Code kept, suggestion set; never done."""
    new = actions.select(*STEP_KEY, F.col("code").alias("_new"))
    return states.join(new, [*STEP_KEY]).select(
        *STEP_KEY, "code", F.col("_new").alias("suggested_completion"), F.lit(False).alias("done")
    )


def decided_code(action: Column, suggestion: Column, code: Column) -> Column:
    return F.when(action == "accept", suggestion).otherwise(code)


def fork_futures(trajectories: DataFrame, futures: int) -> DataFrame:
    """Start ``futures`` futures from the initial and after-assistant states of future 0."""
    shared = trajectories.where((F.col("future") == 0) & (F.col("step") <= 1))
    return shared.withColumn("future", F.explode(F.sequence(F.lit(0), F.lit(futures - 1))))


def graded_by(results: DataFrame) -> list[str]:
    """What a grade is for: as much of run, future and episode as the results carry."""
    return [name for name in EPISODE_KEY if name in results.columns]


def keep_passed(rows: DataFrame, results: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows of episodes graded fully correct.

    ``keys`` says what a grade is for. By default that is run, future and
    episode, so futures of one episode go or stay by their own grades; results
    that do not name a run or future hold for all of them.
    """
    keys = graded_by(results) if keys is None else keys
    passed = results.where(F.col("`pass@1`") == 1).select(*keys)
    spans = rows.groupBy(*EPISODE_KEY).agg(F.max("step").alias("last_step"))
    return with_group_values(
        rows, spans.join(passed, [*keys], "left_semi"), EPISODE_KEY, "step", "last_step", how="left_semi"
    )


# ------------------------------------------------------------------ row windows

def code_growth(trajectories: DataFrame) -> DataFrame:
    """Characters gained since the previous step."""
    narrow = trajectories.select(*STEP_KEY, F.length("code").alias("code_length"))
    stepped = with_previous(narrow, EPISODE_KEY, "step", {"_before": (F.col("code_length"), 1)})
    return stepped.withColumn("growth", F.col("code_length") - F.col("_before")).drop("_before")


def with_two_back(trajectories: DataFrame) -> DataFrame:
    """Code one and two steps back, and the suggestion two steps back."""
    return with_previous(
        trajectories,
        EPISODE_KEY,
        "step",
        {
            "code_1_back": (F.col("code"), 1),
            "code_2_back": (F.col("code"), 2),
            "suggestion_2_back": (F.col("suggested_completion"), 2),
        },
    )


def latest(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = EPISODE_KEY) -> DataFrame:
    """The last step of each episode.

    The last step's number is found on keys alone, and rows are then met by a
    semi join: texts are neither aggregated nor sorted by a window. Steps are
    unique within their keys.
    """
    last = rows.groupBy(*keys).agg(F.max("step").alias("step"))
    return rows.select(*keys, "step", *columns).join(last, [*keys, "step"], "left_semi")


# ------------------------------------------------------------------- per cycle

def code_print(code: Column) -> Column:
    """A fingerprint that stands for a code where only equality matters: its length and 128 bits."""
    return F.struct(
        F.length(code).alias("size"), F.xxhash64(code).alias("x"), F.xxhash64(F.lit(7), code).alias("y")
    )


def cycles(trajectories: DataFrame) -> DataFrame:
    """``episode, cycle, appended, unchanged``: was there an append, and did it leave the code as decided?

    Codes are compared by fingerprint, so only numbers are shuffled and hashed;
    at most three rows meet per group, however long the episode is.
    """
    step = F.col("step")
    phase = F.pmod(step, F.lit(3))
    printed = code_print(F.col("code"))
    narrow = trajectories.where(step > 0).select(
        *EPISODE_KEY, cycle_of(step).alias("cycle"), phase.alias("_phase"), printed.alias("_print")
    )
    parts = ("size", "x", "y")
    picked = {
        f"_{name}_{part}": F.max(F.when(F.col("_phase") == at, F.col(f"_print.{part}")))
        for name, at in (("decided", 2), ("after", 0))
        for part in parts
    }
    met = narrow.groupBy(*EPISODE_KEY, "cycle").agg(
        F.max(F.col("_phase") == 0).alias("appended"), *[value.alias(name) for name, value in picked.items()]
    )
    same = [F.col(f"_decided_{part}") == F.col(f"_after_{part}") for part in parts]
    # Codes that are null on either side are not equal.
    unchanged = F.coalesce(same[0] & same[1] & same[2], F.lit(False))
    return met.select(*EPISODE_KEY, "cycle", "appended", unchanged.alias("unchanged"))


def acceptor_infos(infos: DataFrame, *columns: str) -> DataFrame:
    return infos.where(F.pmod(F.col("step"), F.lit(3)) == 2).select(
        *EPISODE_KEY, cycle_of(F.col("step")).alias("cycle"), *columns
    )


def decided_cycles(trajectories: DataFrame, infos: DataFrame) -> DataFrame:
    """Cycles with the acceptor's action and the step, if any, at which the episode stops there.

    An episode stops when the acceptor finishes or an append changes nothing.
    """
    joined = cycles(trajectories).join(acceptor_infos(infos, "action"), [*EPISODE_KEY, "cycle"], "left")
    return joined.select(
        *EPISODE_KEY,
        "cycle",
        "appended",
        "action",
        F.when(F.col("action") == "finish", F.col("cycle") * 3 + 2)
        .when(F.col("unchanged"), F.col("cycle") * 3 + 3)
        .alias("stop_step"),
    )


def first_stops(decided: DataFrame) -> DataFrame:
    """Per episode: the first stopping step, and the last cycle seen."""
    return decided.groupBy(*EPISODE_KEY).agg(
        F.min("stop_step").alias("first_stop"), F.max("cycle").alias("last_cycle")
    )


def active_after(decided: DataFrame) -> DataFrame:
    """Cycles entered while active, flagged by whether the episode is still active after the append."""
    narrow = decided.select(*EPISODE_KEY, "cycle", "stop_step")
    placed = with_group_values(decided, first_stops(narrow), EPISODE_KEY, "cycle", "last_cycle")
    entered = F.coalesce(F.col("first_stop") > F.col("cycle") * 3, F.lit(True))
    still = F.coalesce(F.col("first_stop") > F.col("cycle") * 3 + 3, F.lit(True))
    return (
        placed.where(entered)
        .withColumn("active", still & F.col("appended"))
        .drop("first_stop", "appended")
    )


def of_phase(trajectories: DataFrame, phase: int, *columns: Column | str) -> DataFrame:
    """``episode, cycle`` and columns of the states after one phase, 0 being the append."""
    step = F.col("step")
    return trajectories.where((F.pmod(step, F.lit(3)) == phase) & (step > 0)).select(
        *EPISODE_KEY, cycle_of(step).alias("cycle"), *columns
    )


def active_spans(trajectories: DataFrame, infos: DataFrame) -> DataFrame:
    """Per episode: ``last_step``, the last one it took while active."""
    stops = (
        decided_cycles(trajectories, infos)
        .groupBy(*EPISODE_KEY)
        .agg(F.min("stop_step").alias("first_stop"))
    )
    spans = trajectories.groupBy(*EPISODE_KEY).agg(F.max("step").alias("last_step"))
    return spans.join(stops, [*EPISODE_KEY], "left").select(
        *EPISODE_KEY, F.least("last_step", "first_stop").alias("last_step")
    )


def with_activity(trajectories: DataFrame, infos: DataFrame) -> DataFrame:
    """Flag each step taken while its episode was active."""
    stops = (
        decided_cycles(trajectories, infos)
        .groupBy(*EPISODE_KEY)
        .agg(F.min("stop_step").alias("first_stop"))
    )
    spans = trajectories.groupBy(*EPISODE_KEY).agg(F.max("step").alias("last_step"))
    limits = spans.join(stops, [*EPISODE_KEY], "left")
    placed = with_group_values(trajectories, limits, EPISODE_KEY, "step", "last_step")
    return placed.withColumn(
        "active", F.coalesce(F.col("step") <= F.col("first_stop"), F.lit(True))
    ).drop("first_stop")


def audit_table(trajectories: DataFrame, infos: DataFrame, problems: DataFrame) -> DataFrame:
    """What each still active cycle saw and did, next to its problem.

    Which cycles those are is found on numbers alone; texts then meet by the
    cycle's key, each in the one row that already holds it.
    """
    keys = [*EPISODE_KEY, "cycle"]
    active = active_after(decided_cycles(trajectories, infos)).where("active").select(*keys, "action")
    shown = of_phase(
        trajectories, 1, *PROBLEM_KEY, F.col("code").alias("code_before"), F.col("suggested_completion").alias("suggestion")
    )
    after = of_phase(trajectories, 0, F.col("code").alias("code_after"))
    rows = active.join(shown, keys, "left").join(after, keys, "left").join(acceptor_infos(infos, "reasoning"), keys, "left")
    hot = heavy_keys(of_phase(trajectories, 1, *PROBLEM_KEY), PROBLEM_KEY)
    return skewed_join(
        rows, problems.select(*PROBLEM_KEY, "question_content"), PROBLEM_KEY, hot, spread_on=keys, how="left"
    ).select(
        *keys,
        F.col("question_content").alias("problem"),
        "code_before",
        "suggestion",
        "action",
        "reasoning",
        "code_after",
    )


# ----------------------------------------------------------------- per episode

def character_totals(trajectories: DataFrame) -> DataFrame:
    """Characters suggested and appended per episode, in one partial aggregation.

    The appended sum is the length after each append less the length before it,
    which is the decision step of the same cycle. A last cycle that was decided
    but not appended to has no such pair, so its decision is taken back out.
    """
    step, length = F.col("step"), F.length("code")
    phase = F.pmod(step, F.lit(3))
    zero = F.lit(0)
    return (
        trajectories.groupBy(*EPISODE_KEY)
        .agg(
            F.sum(F.when(phase == 1, F.length("suggested_completion") - length)).alias("_suggested"),
            F.sum(F.when((phase == 0) & (step > 0), length)).alias("_after"),
            F.sum(F.when(phase == 2, length)).alias("_decided"),
            F.max_by(length, step).alias("final_length"),
            F.max("step").alias("_last"),
        )
        .select(
            *EPISODE_KEY,
            F.coalesce("_suggested", zero).alias("suggested_chars"),
            (
                F.coalesce("_after", zero)
                - F.coalesce("_decided", zero)
                + F.when(F.pmod("_last", F.lit(3)) == 2, F.col("final_length")).otherwise(0)
            ).alias("appended_chars"),
            "final_length",
        )
    )


def enrich_problems(trajectories: DataFrame, infos: DataFrame) -> DataFrame:
    """Per episode: first suggestion with closing fence, final code, was the first suggestion accepted?

    Every episode has a row; what it did not come to, a suggestion or a decision, is null.
    """
    base = trajectories.where(F.col("future") == 0)
    keys = ["run_id", "episode_id"]
    first = base.where(F.col("step") == 1).select(
        *keys, F.concat("suggested_completion", F.lit(fixed.FENCE)).alias("correct_completion")
    )
    final = latest(base, ["code"], keys).drop("step")
    accepted = infos.where((F.col("future") == 0) & (F.col("step") == 2)).select(
        *keys, (F.col("action") == "accept").alias("accepted")
    )
    whole = final.join(first, keys, "left").join(accepted, keys, "left")
    return whole.select(*keys, "correct_completion", "code", "accepted")


def _dataset_keys(dataset: DataFrame) -> list[str]:
    return [name for name in ("run_id", "episode_id") if name in dataset.columns]


def enrich_dataset(dataset: DataFrame, trajectories: DataFrame, infos: DataFrame) -> DataFrame:
    """A dataset with the outcome of its episodes, its own columns kept.

    Adds ``correct_completion, code, accepted`` as ``enrich_problems`` gives them,
    in place of columns of these names. Rows are met by ``episode_id``, and by
    ``run_id`` where the dataset has one; a row without an episode stays, with nulls.
    """
    keys = _dataset_keys(dataset)
    added = ["correct_completion", "code", "accepted"]
    made = enrich_problems(trajectories, infos).select(*keys, *added)
    return dataset.drop(*added).join(made, keys, "left")


def pair_dataset(
    dataset: DataFrame, trajectories: DataFrame, extra: int = fixed.NEXT_STATE_TOKENS
) -> DataFrame:
    """A dataset with the next states and final codes of all futures of its episodes.

    Derived columns of the dataset go, its others stay; ``correct_completion,
    next_state, code`` are those of ``paired_futures``. Rows without an episode go.
    """
    keys = _dataset_keys(dataset)
    added = ["correct_completion", "next_state", "code"]
    made = paired_futures(trajectories, extra).select(*keys, *added)
    return drop_derived(dataset).drop(*added).join(made, keys)


def next_states(trajectories: DataFrame, extra: int = fixed.NEXT_STATE_TOKENS) -> DataFrame:
    """Per episode: final code, and its tokens up to ``extra`` past the code before the append.

    Of the state before the last only the number of its tokens is needed, so one
    text per episode travels. Steps have no gaps; an episode of one state has no
    state before it and a null next state.
    """
    ends = trajectories.groupBy(*EPISODE_KEY).agg(F.max("step").alias("step"))
    before = ends.select(*EPISODE_KEY, (F.col("step") - 1).alias("step"))
    counted = (
        trajectories.select(*STEP_KEY, "code")
        .join(before, [*STEP_KEY], "left_semi")
        .select(*EPISODE_KEY, token_count(F.col("code")).alias("_before"))
    )
    last = latest(trajectories, ["code"]).drop("step")
    cut = head(tokenize(F.col("code")), F.col("_before") + extra)
    return last.join(counted, [*EPISODE_KEY], "left").select(
        *EPISODE_KEY, "code", F.when(F.col("_before").isNotNull(), detokenize(cut)).alias("next_state")
    )


def paired_futures(trajectories: DataFrame, extra: int = fixed.NEXT_STATE_TOKENS) -> DataFrame:
    """Per episode: next states and final codes of all its futures, in order of future.

    A row holds one entry per future, so a group is as long as the number of
    futures the run was set to.
    """
    keys = ["run_id", "episode_id"]
    pairs = (
        next_states(trajectories, extra)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("future", "next_state", "code"))).alias("_futures"))
    )
    first = trajectories.where((F.col("future") == 0) & (F.col("step") == 1)).select(
        *keys, F.col("suggested_completion").alias("correct_completion")
    )
    return pairs.join(first, keys).select(
        *keys,
        "correct_completion",
        F.col("_futures.next_state").alias("next_state"),
        F.col("_futures.code").alias("code"),
    )
