"""Grades: nested lists, JSON payloads, and what runs and futures of their own grades come to."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill import fixed_values as fixed
from tracemill.functions.arrays import join_items
from tracemill.operators import episodes, grades, metrics
from tracemill.plans import views
from tracemill.plans.registry import query, round_all
from tracemill.schemas import EPISODE_KEY

KEYS = "run_id, future, episode_id"


def unfolded(spark, sf):
    trajectories = views.run_trajectories(spark, sf)
    return grades.unfold_grades(views.run_grades(spark, sf), "grades", grades.episode_positions(trajectories))


@query("unfold_grades_s5", f"SELECT {KEYS}, grade AS pass_at_1 FROM v_run_grades")
def unfold_grades(spark, sf):
    return unfolded(spark, sf).withColumnRenamed("pass@1", "pass_at_1")


@query(
    "grade_mismatches_s5",
    """SELECT run_id, future, count(*) - 1 AS grades, count(*) AS episodes FROM v_run_grades
       WHERE run_id % 2 = 1 AND future = 1 GROUP BY run_id, future""",
)
def grade_mismatches(spark, sf):
    """Every other run is short of a grade in its second future."""
    short = F.transform(
        "grades",
        lambda items, i: F.when(
            (F.pmod("run_id", F.lit(2)) == 1) & (i == 1), F.slice(items, 1, F.size(items) - 1)
        ).otherwise(items),
    )
    graded = views.run_grades(spark, sf).withColumn("grades", short)
    positions = grades.episode_positions(views.run_trajectories(spark, sf))
    return grades.length_mismatches(graded, "grades", positions)


@query(
    "keep_passed_futures_f4",
    f"""SELECT {KEYS}, step, code FROM v_runs JOIN v_run_grades USING ({KEYS}) WHERE grade = 1""",
)
def keep_passed_futures(spark, sf):
    """Futures of one episode go or stay by their own grades."""
    kept = episodes.keep_passed(views.run_trajectories(spark, sf), unfolded(spark, sf))
    return kept.select(*EPISODE_KEY, "step", "code")


@query(
    "future_scores_j4",
    f"""SELECT {KEYS}, round(pow({fixed.DISCOUNT_PER_TOKEN}::DOUBLE, {fixed.READING_CHAR_WEIGHT}::DOUBLE * s
            + {fixed.WRITING_CHAR_WEIGHT}::DOUBLE * a) * (grade = 1)::INT, 6) AS score
        FROM (SELECT {KEYS},
                coalesce(sum(CASE WHEN step % 3 = 1 THEN length(suggested_completion) - length(code) END), 0) AS s,
                coalesce(sum(CASE WHEN step % 3 = 0 AND step > 0 THEN length(code) - length(before) END), 0) AS a
              FROM (SELECT *, lag(code) OVER (PARTITION BY {KEYS} ORDER BY step) AS before FROM v_runs)
              GROUP BY {KEYS}) JOIN v_run_grades USING ({KEYS})""",
)
def future_scores(spark, sf):
    scored = metrics.discounted_scores(views.run_trajectories(spark, sf), unfolded(spark, sf))
    return round_all(scored.select(*EPISODE_KEY, "score"))


PAYLOADS = """SELECT doc_id, doc_id % 11 = 3 AS is_cut, doc_id % 11 = 7 AS missing, doc_id % 11 = 5 AS bad,
    quality, toxic, [i % 2 <= quality for i in range(0, doc_id % 4 + 1)] AS tests FROM labels"""


def payloads(spark, sf):
    rows = grades.parse_graded(views.graded_payloads(spark, sf), "payload")
    return grades.parse_errors(rows.select("doc_id", "malformed", "graded.*"), "errors")


@query(
    "graded_payload_s5",
    """SELECT doc_id, is_cut AS malformed, NOT is_cut AND NOT missing AND bad AS malformed_errors,
         CASE WHEN NOT is_cut AND NOT missing THEN doc_id END AS episode_id,
         CASE WHEN NOT is_cut AND NOT missing THEN quality::DOUBLE END AS pass_at_1,
         CASE WHEN NOT is_cut AND NOT missing THEN array_to_string(tests, ',') END AS graded_list,
         CASE WHEN NOT is_cut AND NOT missing THEN
           round(len(list_filter(tests, lambda t: t)) / len(tests), 6) END AS passed,
         CASE WHEN NOT is_cut AND NOT missing THEN 'print(' || doc_id || ')' || chr(10) END AS code,
         CASE WHEN NOT is_cut AND NOT missing AND NOT bad AND quality = 0 THEN CASE toxic WHEN 1 THEN -1 ELSE -2 END END AS error_code,
         CASE WHEN NOT is_cut AND NOT missing AND NOT bad AND quality = 0
              THEN CASE toxic WHEN 1 THEN 'Time Limit' ELSE 'Wrong "Answer"' END END AS error_message
       FROM payloads""",
    payloads=PAYLOADS,
)
def graded_payload(spark, sf):
    return round_all(
        payloads(spark, sf).select(
            "doc_id",
            F.col("malformed").isNotNull().alias("malformed"),
            F.col("malformed_errors").isNotNull().alias("malformed_errors"),
            "episode_id",
            F.col("`pass@1`").alias("pass_at_1"),
            join_items(F.col("graded_list")).alias("graded_list"),
            grades.share_passed(F.col("graded_list")).alias("passed"),
            F.get("code_list", F.lit(0)).alias("code"),
            F.col("errors.error_code").alias("error_code"),
            F.col("errors.error_message").alias("error_message"),
        )
    )


@query(
    "malformed_grades_s5",
    """SELECT count(*) AS checked, count(*) FILTER (is_cut) AS malformed,
              count(*) FILTER (bad) AS malformed_errors FROM payloads""",
    payloads=PAYLOADS,
)
def malformed_grades(spark, sf):
    return grades.malformed_counts(payloads(spark, sf))
