"""Run metrics. ``std`` is the population form unless a name says otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill import fixed_values as fixed
from tracemill.functions.arrays import positions, whole_div
from tracemill.functions.text import lines, suggested_tail
from tracemill.functions.tokens import token_count
from tracemill.operators.episodes import (
    active_after,
    active_spans,
    character_totals,
    code_print,
    cycle_of,
    decided_cycles,
    graded_by,
    latest,
    of_phase,
)
from tracemill.operators.scale import SUM, with_group_values, with_running
from tracemill.schemas import EPISODE_KEY


def standard_error(value: Column) -> Column:
    return F.stddev_pop(value) / F.nullif(F.sqrt(F.count(value)), F.lit(0.0))


def mean_sem_count(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.agg(
        F.avg(value).alias(f"mean_{name}"),
        standard_error(value).alias(f"sem_{name}"),
        F.count(value).alias("n"),
    )


def pass_rate(results: DataFrame) -> DataFrame:
    return results.agg(F.avg("`pass@1`").alias("pass_at_1"))


def action_ratio(infos: DataFrame, action: str) -> DataFrame:
    """Rows with ``action`` over rows with any action; NULL where there are none."""
    return infos.agg(ratio_of(action).alias("ratio"))


def ratio_of(action: str) -> Column:
    return F.try_divide(F.count_if(F.col("action") == action), F.count("action"))


def action_ratios(infos: DataFrame, actions: Sequence[str] = fixed.RATIO_ACTIONS) -> DataFrame:
    """All ratios in one pass."""
    return infos.agg(*[ratio_of(action).alias(f"{action}_ratio") for action in actions])


def latest_action_ratios(infos: DataFrame) -> DataFrame:
    return action_ratios(latest(infos, ["action"]))


def accept_ratio(infos: DataFrame) -> DataFrame:
    """Over the first decision of every episode and future, which is made at step 2."""
    first = infos.where(F.col("step") == 2)
    accepted = F.when(F.col("action").isNotNull(), (F.col("action") == "accept").cast("double"))
    return mean_sem_count(first, accepted, "accept")


def numeric_means(infos: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Mean of each numeric column of a table."""
    numeric = [
        field.name
        for field in infos.schema
        if isinstance(field.dataType, T.NumericType) and field.name not in skip
    ]
    return infos.agg(*[F.avg(name).alias(f"mean_{name}") for name in numeric])


#: Phases of a cycle after which the latest infos are looked at, as steps past the cycle's first.
MOMENTS = {"assistant": 1, "acceptor": 2, "appender": 3}


def latest_per_cycle(
    trajectories: DataFrame,
    infos: DataFrame,
    values: Mapping[str, Column],
    moment: str = "acceptor",
    keys: Sequence[str] = ("run_id", "future"),
) -> DataFrame:
    """Sums over the latest info of every episode, at every cycle: ``*keys, cycle, episodes`` and ``values``.

    ``values`` are expressions over one row of ``infos``; nulls count as nothing.
    The latest info of an episode is that of its last step up to the moment, also
    long after it stopped; a step without an info row has an info without values.
    Cycles run until the last episode of the run stops.

    Every active episode has a step of its own in each cycle, which is summed
    there. One that has stopped brings along the info of its last step, which is
    added once, at the first cycle past it, and carried from cycle to cycle as a
    running sum: no row is made per episode and cycle, and nothing is taken out again.
    """
    if moment not in MOMENTS:
        raise ValueError(f"unknown moment {moment!r}")
    after = MOMENTS[moment]
    spans = active_spans(trajectories, infos)
    rows = infos.select(*EPISODE_KEY, "step", *[value.alias(name) for name, value in values.items()])
    placed = with_group_values(rows, spans.withColumn("_to", F.col("last_step")), EPISODE_KEY, "step", "last_step")
    sums = [F.sum(name).alias(name) for name in values]
    # whole_div rounds towards zero, so it is asked of numbers from 0 only.
    at_moment = (F.pmod("step", F.lit(3)) == after % 3) & (F.col("step") > 0) & (F.col("step") <= F.col("_to"))
    fresh = placed.where(at_moment).groupBy(*keys, cycle_of(F.col("step")).alias("cycle")).agg(*sums)
    stopped = (
        placed.where(F.col("step") == F.col("_to"))
        .groupBy(*keys, whole_div(F.col("step") + (3 - after), 3).alias("cycle"))
        .agg(*[F.sum(name).alias(f"_kept_{name}") for name in values])
    )
    runs = spans.groupBy(*keys).agg(F.count("*").alias("episodes"), F.max("last_step").alias("_to"))
    last_cycle = F.when(F.col("_to") > 0, cycle_of(F.col("_to"))).otherwise(-1)
    cycles = runs.select(*keys, "episodes", F.explode(positions(last_cycle + 1)).alias("cycle")).withColumn(
        "cycle", F.col("cycle").cast("long")
    )
    joined = cycles.join(fresh, [*keys, "cycle"], "left").join(stopped, [*keys, "cycle"], "left")
    carried = with_running(joined, keys, "cycle", {f"_all_{name}": (SUM, F.col(f"_kept_{name}")) for name in values})
    return carried.select(
        *keys,
        "cycle",
        "episodes",
        *[(F.coalesce(name, F.lit(0)) + F.coalesce(f"_all_{name}", F.lit(0))).alias(name) for name in values],
    )


def action_ratios_per_cycle(
    trajectories: DataFrame,
    infos: DataFrame,
    actions: Sequence[str] = fixed.RATIO_ACTIONS,
    keys: Sequence[str] = ("run_id", "future"),
) -> DataFrame:
    """Per cycle: the share of each action among the latest infos that have one; NULL where none has."""
    counted = {action: (F.col("action") == action).cast("long") for action in actions}
    counted["_any"] = F.col("action").isNotNull().cast("long")
    totals = latest_per_cycle(trajectories, infos, counted, "acceptor", keys)
    return totals.select(
        *keys,
        "cycle",
        "episodes",
        F.col("_any").alias("with_action"),
        *[F.try_divide(F.col(action), F.col("_any")).alias(f"{action}_ratio") for action in actions],
    )


def numeric_means_per_cycle(
    trajectories: DataFrame,
    infos: DataFrame,
    moment: str = "acceptor",
    keys: Sequence[str] = ("run_id", "future"),
    skip: Sequence[str] = (*EPISODE_KEY, "step"),
) -> DataFrame:
    """Per cycle: the mean of each numeric field over the latest infos that have it."""
    names = [f.name for f in infos.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]
    values = {}
    for name in names:
        values[f"_sum_{name}"] = F.col(name).cast("double")
        values[f"_n_{name}"] = F.col(name).isNotNull().cast("long")
    totals = latest_per_cycle(trajectories, infos, values, moment, keys)
    return totals.select(
        *keys,
        "cycle",
        "episodes",
        *[F.try_divide(F.col(f"_sum_{name}"), F.col(f"_n_{name}")).alias(f"mean_{name}") for name in names],
    )


def action_lengths(trajectories: DataFrame) -> DataFrame:
    """Tokens the first suggestion adds to the code it was made for."""
    added = token_count(F.col("suggested_completion")) - token_count(F.col("code"))
    first = trajectories.where((F.col("future") == 0) & (F.col("step") == 1))
    return mean_sem_count(first.select(added.alias("added")), F.col("added"), "action_length")


def suggested_lengths(trajectories: DataFrame) -> DataFrame:
    """Tokens of the new part of every suggestion."""
    tail = suggested_tail(F.col("code"), F.col("suggested_completion"))
    steps = trajectories.where(F.pmod(F.col("step"), F.lit(3)) == 1)
    return mean_sem_count(steps.select(token_count(tail).alias("tokens")), F.col("tokens"), "completion_length")


def kept_length(examples: DataFrame, kept: str, state: str) -> DataFrame:
    return examples.agg(F.avg(F.size(kept) - F.size(state)).alias("mean_kept_length"))


def final_lengths(trajectories: DataFrame) -> DataFrame:
    """Characters of the final code; only lengths are shuffled."""
    final = trajectories.groupBy(*EPISODE_KEY).agg(
        F.max_by(F.length("code"), F.col("step")).alias("chars")
    )
    return final.agg(F.avg("chars").alias("mean_chars"), F.stddev_pop("chars").alias("std_chars"))


def discounted_scores(
    trajectories: DataFrame,
    results: DataFrame,
    discount: float = fixed.DISCOUNT_PER_TOKEN,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Per episode: a pass, discounted by characters read and written.

    ``keys`` says what a grade is for: run, future and episode, or as much of it as the results carry.
    """
    keys = graded_by(results) if keys is None else keys
    weighted = (
        F.col("suggested_chars") * fixed.READING_CHAR_WEIGHT
        + F.col("appended_chars") * fixed.WRITING_CHAR_WEIGHT
    )
    passed = (F.col("`pass@1`") == 1).cast("double")
    return (
        character_totals(trajectories)
        .join(results.where(F.col("`pass@1`").isNotNull()), [*keys])
        .withColumn("score", F.pow(F.lit(discount), weighted) * passed)
    )


def discounted_pass_rate(
    trajectories: DataFrame,
    results: DataFrame,
    discount: float = fixed.DISCOUNT_PER_TOKEN,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    scores = discounted_scores(trajectories, results, discount, keys)
    return mean_sem_count(scores, F.col("score"), "discounted_pass")


def active_per_cycle(trajectories: DataFrame, infos: DataFrame) -> DataFrame:
    """Per cycle: episodes that entered it, and those still active at its end."""
    rows = active_after(decided_cycles(trajectories, infos))
    return rows.groupBy("cycle").agg(
        F.count("*").alias("entered"), F.count_if(F.col("active")).alias("active")
    )


def implicit_acceptance(trajectories: DataFrame, infos: DataFrame) -> DataFrame:
    """Per cycle: share of active episodes that retyped a suggestion they had not accepted.

    A cycle without an active episode has a NULL rate.
    """
    # What is left of a suggestion is a print of it: an append is compared with it where its own code is.
    keys = [*EPISODE_KEY, "cycle"]
    suggestion = F.col("suggested_completion")
    shown = of_phase(
        trajectories,
        1,
        code_print(suggestion).alias("_print"),
        (F.length(suggestion) > F.length("code")).alias("_longer"),
    )
    start = F.substring(F.col("code"), F.lit(1), F.col("_print.size"))
    appended = of_phase(trajectories, 0, "code").join(shown, keys, "left")
    starts = appended.select(*keys, (F.col("_longer") & (code_print(start) == F.col("_print"))).alias("_starts"))
    flagged = decided_cycles(trajectories, infos).join(starts, keys, "left")
    retyped = F.coalesce((F.col("action") != "accept") & F.col("_starts"), F.lit(False))
    return active_after(flagged.withColumn("retyped", retyped)).groupBy("cycle").agg(
        F.avg(F.when(F.col("active"), F.col("retyped").cast("double"))).alias("implicit_acceptance_rate")
    )


def line_changes(rows: DataFrame, keys: Sequence[str], before: Column, after: Column) -> DataFrame:
    """Lines added and removed between two texts of a row, as multiset differences.

    All lines of both texts, signed, are put in order inside the row; equal lines
    are then neighbours and one fold counts what is left of each. Nothing is
    shuffled. A row with a missing text has no changes.
    """
    signed = F.concat(
        F.transform(lines(before), lambda line: F.struct(line.alias("line"), F.lit(-1).alias("sign"))),
        F.transform(lines(after), lambda line: F.struct(line.alias("line"), F.lit(1).alias("sign"))),
    )
    none = F.lit(0).cast("long")

    def state(line: Column, net: Column, added: Column, removed: Column) -> Column:
        return F.struct(line.alias("line"), net.alias("net"), added.alias("added"), removed.alias("removed"))

    def step(seen: Column, item: Column) -> Column:
        sign = item["sign"].cast("long")
        return F.when(
            item["line"] == seen["line"], state(seen["line"], seen["net"] + sign, seen["added"], seen["removed"])
        ).otherwise(
            state(
                item["line"],
                sign,
                seen["added"] + F.greatest(seen["net"], none),
                seen["removed"] + F.greatest(-seen["net"], none),
            )
        )

    folded = F.aggregate(
        F.coalesce(F.sort_array(signed), F.array().cast("array<struct<line:string,sign:int>>")),
        state(F.lit(None).cast("string"), none, none, none),
        step,
        lambda seen: F.struct(
            (seen["added"] + F.greatest(seen["net"], none)).alias("added_lines"),
            (seen["removed"] + F.greatest(-seen["net"], none)).alias("removed_lines"),
        ),
    )
    return rows.select(*keys, folded.alias("_changes")).select(*keys, "_changes.*")
