"""Grades of episodes: from positional lists and JSON payloads to keyed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.scale import global_rank
from tracemill.schemas import CORRUPT, EPISODE_KEY, ERRORS, GRADED


def episode_positions(trajectories: DataFrame) -> DataFrame:
    """``run_id, future, position, episode_id``: the places from 0 of a run's episodes, in order of their ids.

    Ranks come from ranges of all episodes, so a run of any size is numbered by many tasks.
    """
    episodes = trajectories.select(*EPISODE_KEY).distinct()
    ranked = global_rank(episodes, [F.asc(name) for name in EPISODE_KEY], "_rank")
    firsts = ranked.groupBy("run_id", "future").agg(F.min("_rank").alias("_first"))
    return ranked.join(firsts, ["run_id", "future"]).select(
        "run_id", "future", (F.col("_rank") - F.col("_first")).alias("position"), "episode_id"
    )


def unfold_grades(graded: DataFrame, grades: str, positions: DataFrame, strict: bool = True) -> DataFrame:
    """``run_id, future, episode_id, pass@1`` from one list per run of one list per future.

    The j-th grade of a future is that of the episode at place j of ``positions``
    (``run_id, future, position, episode_id``). A grade without an episode, and an
    episode without a grade, mean that list and history are not of one run: that
    is an error, or with ``strict=False`` rows in which one of the two is null.
    """
    by_future = graded.select("run_id", F.posexplode(grades).alias("future", "_grades"))
    by_place = by_future.select("run_id", "future", F.posexplode("_grades").alias("position", "pass@1"))
    places = by_place.withColumn("position", F.col("position").cast("long")).withColumn("_graded", F.lit(True))
    joined = places.join(positions, ["run_id", "future", "position"], "full")
    whole = F.col("episode_id").isNotNull() & F.col("_graded").isNotNull()
    told = F.concat_ws(
        " ", F.lit("grades and history differ: run, future and place"), "run_id", "future", "position"
    )
    grade = F.col("`pass@1`").cast("double")
    checked = F.when(whole, grade).otherwise(F.raise_error(told).cast("double")) if strict else grade
    return joined.select(*EPISODE_KEY, checked.alias("pass@1"))


def length_mismatches(graded: DataFrame, grades: str, positions: DataFrame) -> DataFrame:
    """``run_id, future, grades, episodes`` of every future whose list is not as long as its history."""
    lists = graded.select("run_id", F.posexplode(grades).alias("future", "_grades")).select(
        "run_id", "future", F.coalesce(F.array_size("_grades"), F.lit(0)).cast("long").alias("grades")
    )
    histories = positions.groupBy("run_id", "future").agg(F.count("*").alias("episodes"))
    zero = F.lit(0).cast("long")
    return (
        lists.join(histories, ["run_id", "future"], "full")
        .select("run_id", "future", F.coalesce("grades", zero).alias("grades"), F.coalesce("episodes", zero).alias("episodes"))
        .where("grades <> episodes")
    )


def parse_graded(df: DataFrame, payload: str) -> DataFrame:
    """Replace a JSON text column by ``graded``, a typed record of one graded problem, and ``malformed``.

    ``malformed`` holds the whole text where it is no such record, and is null
    otherwise; fields that could be read are kept. A missing payload is neither:
    its ``graded`` is null.
    """
    parsed = F.from_json(payload, GRADED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    record = F.struct(*[F.col(f"_parsed.`{field.name}`") for field in GRADED if field.name != CORRUPT])
    return (
        df.withColumn("_parsed", parsed)
        .withColumn("malformed", F.col(f"_parsed.{CORRUPT}"))
        .withColumn("graded", F.when(F.col("_parsed").isNotNull() & F.col(payload).isNotNull(), record))
        .drop("_parsed", payload)
    )


def parse_errors(df: DataFrame, errors: str) -> DataFrame:
    """Replace a JSON text column of a grader's errors by a typed ``errors`` and ``malformed_errors``."""
    parsed = F.from_json(errors, ERRORS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    record = F.struct(*[F.col(f"_parsed.{field.name}") for field in ERRORS if field.name != CORRUPT])
    out = df.withColumn("_parsed", parsed).withColumn("malformed_errors", F.col(f"_parsed.{CORRUPT}"))
    given = F.col(errors).isNotNull() & F.col("malformed_errors").isNull()
    return out.withColumn("errors", F.when(given, record)).drop("_parsed", *([errors] if errors != "errors" else []))


def malformed_counts(rows: DataFrame, columns: Sequence[str] = ("malformed", "malformed_errors")) -> DataFrame:
    """``checked`` rows, and how many of them are malformed in each of the columns."""
    return rows.agg(F.count("*").alias("checked"), *[F.count(name).alias(name) for name in columns])


def share_passed(graded_list: Column) -> Column:
    """Share of tests passed; null where there was none."""
    return F.try_divide(F.size(F.filter(graded_list, lambda passed: passed)), F.nullif(F.size(graded_list), F.lit(0)))
