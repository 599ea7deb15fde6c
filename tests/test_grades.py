"""Grades by run, future and episode, and the JSON they come in."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill import schemas
from tracemill.operators import episodes, grades, metrics
from tracemill.sources import readers

STATES = "run_id long, future int, episode_id long, step long, code string, suggested_completion string"
GRADES = "run_id long, grades array<array<double>>"


@pytest.fixture
def futures(spark):
    """Two runs; in run 7 two futures of episodes 10, 11, 30, in run 8 one future of episode 10."""
    rows = [
        (run, future, episode, step, f"{future}{episode}"[: step + 1], "s" * 5 if step == 1 else None)
        for run, future, ids in ((7, 0, (10, 11, 30)), (7, 1, (10, 11, 30)), (8, 0, (10,)))
        for episode in ids
        for step in range(3)
    ]
    return spark.createDataFrame(rows, STATES)


def unfolded(spark, futures, **lists):
    graded = spark.createDataFrame([(int(run[1:]), values) for run, values in lists.items()], GRADES)
    return graded, grades.episode_positions(futures)


def test_unequal_grades_of_futures_are_kept_apart(spark, futures):
    graded, positions = unfolded(spark, futures, r7=[[1.0, 0.0, None], [0.0, 1.0, 1.0]], r8=[[1.0]])
    rows = grades.unfold_grades(graded, "grades", positions)
    got = {tuple(r) for r in rows.select("run_id", "future", "episode_id", "pass@1").collect()}
    assert got == {
        (7, 0, 10, 1.0), (7, 0, 11, 0.0), (7, 0, 30, None), (7, 1, 10, 0.0), (7, 1, 11, 1.0), (7, 1, 30, 1.0), (8, 0, 10, 1.0),
    }
    kept = episodes.keep_passed(futures, rows)
    assert {(r.run_id, r.future, r.episode_id) for r in kept.collect()} == {(7, 0, 10), (7, 1, 11), (7, 1, 30), (8, 0, 10)}
    assert kept.count() == 12
    scores = {(r.run_id, r.future, r.episode_id): r.score for r in metrics.discounted_scores(futures, rows).collect()}
    assert scores[7, 0, 10] > 0 and scores[7, 1, 10] == 0 and (7, 0, 30) not in scores
    # Results that name no run or future hold for all of them.
    wide = spark.createDataFrame([(10, 1.0)], schemas.RESULTS)
    assert {(r.run_id, r.future) for r in episodes.keep_passed(futures, wide).collect()} == {(7, 0), (7, 1), (8, 0)}
    assert grades.length_mismatches(graded, "grades", positions).count() == 0


@pytest.mark.parametrize(
    "lists, wrong",
    [
        ({"r7": [[1.0, 0.0], [0.0, 1.0, 1.0]], "r8": [[1.0]]}, {(7, 0, 2, 3)}),
        ({"r7": [[1.0, 0.0, 1.0], [0.0, 1.0, 1.0, 1.0]], "r8": [[1.0]]}, {(7, 1, 4, 3)}),
        ({"r7": [[1.0, 0.0, 1.0]], "r8": [[1.0]]}, {(7, 1, 0, 3)}),
        ({"r7": [[1.0, 0.0, 1.0], None], "r8": [[]]}, {(7, 1, 0, 3), (8, 0, 0, 1)}),
        ({"r7": [[1.0, 0.0, 1.0], [1.0, 1.0, 1.0]], "r8": [[1.0]], "r9": [[1.0]]}, {(9, 0, 1, 0)}),
    ],
)
def test_lists_that_do_not_fit_their_history(spark, futures, lists, wrong):
    graded, positions = unfolded(spark, futures, **lists)
    assert {tuple(r) for r in grades.length_mismatches(graded, "grades", positions).collect()} == wrong
    with pytest.raises(Exception, match="grades and history differ"):
        grades.unfold_grades(graded, "grades", positions).collect()
    loose = grades.unfold_grades(graded, "grades", positions, strict=False)
    assert loose.where("episode_id IS NULL OR `pass@1` IS NULL").count() == sum(abs(a - b) for _, _, a, b in wrong)


def test_no_grades(spark, futures):
    graded, positions = unfolded(spark, futures)
    empty = grades.episode_positions(futures.limit(0))
    assert grades.unfold_grades(graded, "grades", empty).count() == 0
    assert grades.length_mismatches(graded, "grades", positions).count() == 3


RECORD = {
    "episode_id": 4,
    "question_id": "A",
    "code_list": ["print(1)\n", "é"],
    "graded_list": [True, False, True],
    "pass@1": 0.0,
    "errors": {"error_code": -2, "error_message": "Wrong Answer", "output": "1"},
    "other": [1, {"deep": None}],
}


def test_graded_records_by_line(spark, tmp_path):
    lines = [
        json.dumps(RECORD),
        json.dumps(RECORD)[:-9],
        json.dumps({**RECORD, "errors": json.dumps(RECORD["errors"])}),
        json.dumps({**RECORD, "errors": "{broken"}),
        json.dumps({"episode_id": 5, "graded_list": None}),
        "",
        "no json at all",
    ]
    (tmp_path / "g.jsonl").write_text("\n".join(lines))
    got = readers.read_graded(spark, str(tmp_path / "g.jsonl"), multi_line=False).collect()
    assert len(got) == 6
    good = [r for r in got if r.malformed is None]
    assert sorted(r.malformed for r in got if r.malformed) == sorted([lines[1], lines[6]])
    assert [r.graded_list for r in good if r.episode_id == 4] == [[True, False, True]] * 3
    assert all(r.code_list == ["print(1)\n", "é"] and r["pass@1"] == 0.0 for r in good if r.episode_id == 4)
    assert sorted(str(r.errors and r.errors.error_code) for r in good) == ["-2", "-2", "None", "None"]
    assert [r.malformed_errors for r in good if r.malformed_errors] == ["{broken"]
    frame = readers.read_graded(spark, str(tmp_path / "g.jsonl"), multi_line=False)
    assert tuple(grades.malformed_counts(frame).first()) == (6, 2, 1)


def test_graded_array(spark, tmp_path):
    (tmp_path / "whole.json").write_text(json.dumps([RECORD, {**RECORD, "episode_id": 5, "errors": None}, 17], indent=4))
    got = readers.read_graded(spark, str(tmp_path / "whole.json")).collect()
    assert sorted((str(r.episode_id), str(r.malformed)) for r in got) == [("4", "None"), ("5", "None"), ("None", "17")]
    (tmp_path / "broken.json").write_text('[{"episode_id": 4}, {"epi')
    got = readers.read_graded(spark, str(tmp_path / "broken.json")).collect()
    assert [r.malformed for r in got] == ['[{"episode_id": 4}, {"epi']


def test_share_passed(evaluate):
    for values, share in (([True, False], 0.5), ([], None), (None, None), ([True, None], 0.5)):
        assert evaluate(grades.share_passed(F.col("g")), "g array<boolean>", g=values) == share
