"""Checks as one-row violation counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import fixed_values as fixed
from tracemill.functions.arrays import head
from tracemill.functions.text import clean_snippet
from tracemill.functions.tokens import last_non_eos_index
from tracemill.operators.episodes import character_totals


def violations(df: DataFrame, broken: Column) -> DataFrame:
    """Rows checked and rows that break a rule; an undecidable row counts as broken."""
    return df.agg(
        F.count("*").alias("checked"), F.count_if(F.coalesce(broken, F.lit(True))).alias("violations")
    )


def missing_suggestions(trajectories: DataFrame) -> DataFrame:
    at_acceptor = trajectories.where(F.pmod(F.col("step"), F.lit(3)) == 1)
    return violations(at_acceptor, F.col("suggested_completion").isNull())


def overlong_appends(trajectories: DataFrame) -> DataFrame:
    """Episodes whose appended characters exceed their final code."""
    return violations(character_totals(trajectories), F.col("appended_chars") > F.col("final_length"))


def bad_labels(df: DataFrame, masked_length: str) -> DataFrame:
    """Rows with no label, a label unlike its id, or a label inside the prompt."""
    none = ~F.exists("labels", lambda label: label != fixed.IGNORED_LABEL)
    unlike = F.exists(
        F.zip_with(
            "labels", "input_ids", lambda label, token: (label != fixed.IGNORED_LABEL) & (label != token)
        ),
        lambda bad: bad,
    )
    early = F.exists(
        head(F.col("labels"), F.col(masked_length)), lambda label: label != fixed.IGNORED_LABEL
    )
    return violations(df, none | unlike | early)


def wrong_lengths(df: DataFrame, column: str, length: int = fixed.PAD_LENGTH, exact: bool = False) -> DataFrame:
    size = F.size(column)
    return violations(df, size != length if exact else size > length)


def states_without_tokens(df: DataFrame, ids: str, eos_id: int) -> DataFrame:
    return violations(df, last_non_eos_index(F.col(ids), eos_id) < 0)


def decode_mismatches(decoded: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose decoded text, cleaned, is not the expected code; reported, not fatal."""
    return (
        decoded.join(expected, keys)
        .withColumn("cleaned", clean_snippet(F.col("text")))
        .where(~F.col("cleaned").eqNullSafe(F.col("code")))
    )


def missing_code_ids(trajectories: DataFrame) -> DataFrame:
    return violations(trajectories, F.col("code_iids").isNull())


def unmatched_codes(problems: DataFrame, codes: DataFrame, keys: list[str]) -> DataFrame:
    """Problems without a code and codes without a problem: both must be 0 before attaching."""
    left = problems.select(*keys).withColumn("_side", F.lit(1))
    right = codes.select(*keys).withColumn("_side", F.lit(2))
    sides = left.unionByName(right).groupBy(*keys).agg(F.sum("_side").alias("_sides"))
    return sides.agg(F.count("*").alias("checked"), F.count_if(F.col("_sides") != 3).alias("violations"))
