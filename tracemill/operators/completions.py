"""Choosing how much of a completion to train on, and weighting the choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import fixed_values as fixed
from tracemill.functions.arrays import head
from tracemill.functions.tokens import last_non_eos_index, seeded_int, softmax_at

CHOOSERS = fixed.CHOOSERS


def unravel_futures(df: DataFrame, code: str = "code_ids", others: str = "null_ids") -> DataFrame:
    """One row per future: 0 continues the true code, i the (i-1)-th other code."""
    every = F.concat(F.array(code), F.col(others))
    return df.select("*", F.posexplode(every).alias("future", "completion_ids"))


def matrix_mean(matrix: Column) -> Column:
    flat = F.flatten(matrix)
    total = F.aggregate(flat, F.lit(0.0), lambda done, x: done + x.cast("double"))
    return F.try_divide(total, F.size(flat))


def choose_completions(
    df: DataFrame,
    chooser: str,
    eos_id: int,
    seed: int = 0,
    key: str = "example_id",
    longest: int = fixed.LONGEST_COMPLETION,
    shortest: int = fixed.SHORTEST_COMPLETION,
) -> DataFrame:
    """Cut each future's completion and score it.

    Input, one row per future: ``state_ids`` (padded with the end token),
    ``completion_ids``, the score matrix ``q`` and the ``future`` it belongs to.
    Adds ``chosen_ids``, ``score_q``, ``score_v`` and ``score_a``.
    """
    if chooser not in CHOOSERS:
        raise ValueError(f"unknown chooser {chooser!r}, use one of {CHOOSERS}")
    after_state = last_non_eos_index(F.col("state_ids"), eos_id) + 1
    row = F.get(F.col("q"), F.col("future"))
    mean = matrix_mean(F.col("q"))
    zero = F.lit(0.0)
    drawn = seeded_int(longest, seed, F.col(key), F.col("future"))
    if chooser == "empowerment":
        best = F.array_position(row, F.array_max(row)) - 1
        length, q, v = best + 1, F.get(row, best.cast("int")).cast("double"), mean
    elif chooser == "longest":
        length, q, v = F.lit(longest), zero, mean
    elif chooser == "random":
        length, q, v = drawn + 1, F.get(row, drawn.cast("int")).cast("double"), mean
    elif chooser == "longest_random":
        length, q, v = drawn + 1, -drawn.cast("double"), zero
    else:
        length, q, v = F.lit(shortest), zero, mean
    return (
        df.withColumn("chosen_ids", head(F.col("completion_ids"), after_state + length))
        .withColumn("score_q", q)
        .withColumn("score_v", v)
        .withColumn("score_a", F.col("score_q") - F.col("score_v"))
    )


def advantage_statistics(df: DataFrame, advantage: str = "score_a") -> DataFrame:
    """Mean and sample standard deviation over the training split."""
    return df.where(F.col("split") == "train").agg(
        F.avg(advantage).alias("advantage_mean"), F.stddev_samp(advantage).alias("advantage_std")
    )


def sample_weights(df: DataFrame, strategy: str, temperature: float, advantage: str = "score_a") -> DataFrame:
    """Add ``weight``; the statistics enter as scalars of one small aggregate.

    A zero spread gives a NULL weight. Any strategy but the two known weighs 1.
    """
    if strategy not in ("awr", "wbc"):
        return df.withColumn("weight", F.lit(1.0))
    stats = advantage_statistics(df, advantage)
    mean = stats.select("advantage_mean").scalar()
    std = stats.select("advantage_std").scalar()
    scaled = F.try_divide(F.col(advantage) - mean, std * F.lit(temperature))
    if strategy == "wbc":
        return df.withColumn("weight", scaled)
    # exp overflows to infinity, which the ceiling then catches.
    clipped = F.greatest(F.least(F.exp(scaled), F.lit(fixed.WEIGHT_CEILING)), F.lit(fixed.WEIGHT_FLOOR))
    return df.withColumn("weight", F.when(scaled.isNotNull(), clipped))


def next_token_probabilities(
    logits: DataFrame,
    keys: list[str],
    position: str = "pos",
    token: str = "token_id",
    vector: str = "logits",
    lengths: DataFrame | None = None,
) -> DataFrame:
    """Probability of each token given the logits one position before it.

    With ``lengths`` only at the positions ``last_positions`` asks for; they are
    found on narrow columns, before any logits are met.

    A position meets its predecessor by an equi-join on key and position, which
    spreads a long sequence like any other rows.
    """
    targets = logits.select(*keys, position, F.col(token).alias("_token"))
    if lengths is not None:
        targets = last_positions(targets, lengths, keys, position)
    targets = targets.select(*keys, (F.col(position) - 1).alias("_at"), "_token")
    givers = logits.select(*keys, F.col(position).alias("_at"), vector)
    return givers.join(targets, [*keys, "_at"]).select(
        *keys,
        (F.col("_at") + 1).alias(position),
        F.col("_token").alias(token),
        softmax_at(F.col(vector), F.col("_token")).alias("prob"),
    )


def last_positions(rows: DataFrame, lengths: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """Rows at the last ``remaining`` of ``n_tokens`` positions; none when nothing remains."""
    return (
        rows.join(lengths, keys)
        .where(F.col(position) >= F.col("n_tokens") - F.col("remaining"))
        .drop("n_tokens", "remaining")
    )
