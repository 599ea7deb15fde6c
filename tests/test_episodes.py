import math

import pytest
from pyspark.sql import functions as F

from tracemill import schemas
from tracemill.operators import curation, episodes, metrics, quality


def states(spark, *histories):
    """Each history lists (code, suggestion) by step."""
    rows = [
        (0, 0, episode, step, "1", "A", code, suggestion, None)
        for episode, history in enumerate(histories)
        for step, (code, suggestion) in enumerate(history)
    ]
    return spark.createDataFrame(rows, schemas.TRAJECTORIES)


def infos(spark, *rows):
    return spark.createDataFrame(
        [(0, 0, episode, step, "why", None, action, None, None, None) for episode, step, action in rows], schemas.INFOS
    )


@pytest.fixture
def sample(spark):
    """Episode 0 retypes, then appends nothing; 1 accepts, then finishes; 2 stops after deciding."""
    trajectories = states(
        spark,
        [("", None), ("", "ab"), ("", None), ("abc", None), ("abc", "abcd"), ("abc", None), ("abc", None)],
        [("x", None), ("x", "xy"), ("xy", None), ("xyz", None), ("xyz", "xyz!"), ("xyz", None)],
        [("q", None), ("q", "q1"), ("q1", None)],
    )
    decisions = infos(
        spark,
        (0, 2, "reject"), (0, 5, "reject"), (1, 2, "accept"), (1, 5, "finish"), (2, 2, "accept"),
        (0, 1, None), (0, 3, None),
    )
    return trajectories, decisions


def test_character_totals(sample):
    got = {r.episode_id: (r.suggested_chars, r.appended_chars, r.final_length) for r in episodes.character_totals(sample[0]).collect()}
    assert got == {0: (3, 3, 3), 1: (2, 1, 3), 2: (1, 0, 2)}


def test_growth_and_phase(sample):
    growth = {(r.episode_id, r.step): r.growth for r in episodes.code_growth(sample[0]).collect()}
    assert growth[(0, 0)] is None and growth[(0, 3)] == 3 and growth[(1, 2)] == 1
    phases = sample[0].where("episode_id = 0").select(episodes.phase_of(F.col("step")).alias("p"), "step").orderBy("step")
    assert [r.p for r in phases.collect()] == ["initial", "assistant", "acceptor", "appender", "assistant", "acceptor", "appender"]


def test_activity(spark):
    trajectories = states(
        spark,
        [("a", None), ("a", "ab"), ("a", None), ("a", None), ("a", "x"), ("a", None), ("b", None)],
        [("a", None), ("a", "ab"), ("a", None), ("b", None), ("b", "bc"), ("b", None), ("c", None)],
    )
    decisions = infos(spark, (0, 2, "reject"), (0, 5, "reject"), (1, 2, "reject"), (1, 5, "finish"))
    flags = episodes.with_activity(trajectories, decisions)
    active = {(r.episode_id, r.step) for r in flags.where("active").collect()}
    assert active == {(0, s) for s in range(4)} | {(1, s) for s in range(6)}
    counts = {r.cycle: (r.entered, r.active) for r in metrics.active_per_cycle(trajectories, decisions).collect()}
    assert counts == {0: (2, 1), 1: (1, 0)}


def test_implicit_acceptance(sample):
    rates = {r.cycle: r.implicit_acceptance_rate for r in metrics.implicit_acceptance(*sample).collect()}
    # Cycle 0: episode 0 retyped, episode 1 accepted. Cycle 1: nobody is left.
    assert rates == {0: 0.5, 1: None}


def test_action_ratios(sample, spark):
    row = metrics.action_ratios(sample[1]).first()
    assert (row.accept_ratio, row.reject_ratio, row.finish_ratio, row.append_ratio) == (0.4, 0.4, 0.2, 0.0)
    assert metrics.action_ratio(infos(spark, (0, 1, None)), "accept").first().ratio is None
    latest = metrics.latest_action_ratios(sample[1].where("action is not null")).first()
    assert math.isclose(latest.finish_ratio, 1 / 3)


def test_accept_ratio_takes_first_decisions(spark):
    rows = [(0, 2, "accept"), (0, 5, "reject"), (0, 8, "reject"), (1, 2, "accept"), (2, 2, None)]
    row = metrics.accept_ratio(spark.createDataFrame(rows, "episode_id int, step int, action string")).first()
    assert row.mean_accept == 1.0 and row.n == 2


def test_discounted_pass_rate(sample, spark):
    results = spark.createDataFrame([(0, 1.0), (1, 0.5), (2, None)], schemas.RESULTS)
    scores = {r.episode_id: r.score for r in metrics.discounted_scores(sample[0], results).collect()}
    assert scores.keys() == {0, 1} and scores[1] == 0.0
    assert math.isclose(scores[0], 0.999 ** (0.1 * 3 + 0.5 * 3))
    row = metrics.discounted_pass_rate(sample[0], results).first()
    assert row.n == 2 and math.isclose(row.sem_discounted_pass, scores[0] / 2 / math.sqrt(2))


def test_transitions(spark):
    before = states(spark, [("a", "ab")], [("c", "cd")])
    actions = states(spark, [("ab", None)], [("c", None)])
    human = {r.episode_id: (r.code, r.suggested_completion, r.done) for r in episodes.apply_human_actions(before, actions).collect()}
    assert human == {0: ("ab", None, False), 1: ("c", None, True)}
    helped = {r.episode_id: (r.code, r.suggested_completion, r.done) for r in episodes.apply_assistant_actions(before, actions).collect()}
    assert helped == {0: ("a", "ab", False), 1: ("c", "c", False)}


def test_fork_and_pair(spark):
    base = states(spark, [("s", None), ("s", "s t")])
    forked = episodes.fork_futures(base, 3)
    assert forked.count() == 6 and {r.future for r in forked.collect()} == {0, 1, 2}
    tail = spark.createDataFrame(
        [(0, k, 0, step, "1", "A", code, None, None) for k in range(3) for step, code in ((2, "s"), (3, "s " + " ".join(map(str, range(k * 10)))))],
        schemas.TRAJECTORIES,
    )
    pair = episodes.paired_futures(forked.unionByName(tail)).first()
    assert pair.correct_completion == "s t"
    assert [len(code.split()) for code in pair.code] == [1, 11, 21]
    assert [len(state.split()) for state in pair.next_state] == [1, 11, 11]


def test_enrich_and_filter(sample, spark):
    rows = {r.episode_id: r for r in episodes.enrich_problems(*sample).collect()}
    assert rows[1].correct_completion == "xy```" and rows[1].code == "xyz" and rows[1].accepted
    assert not rows[0].accepted
    results = spark.createDataFrame([(0, 1.0), (1, 0.99)], schemas.RESULTS)
    assert {r.episode_id for r in episodes.keep_passed(sample[0], results).collect()} == {0}
    graded = results.withColumn("future", F.lit(1))
    assert episodes.keep_passed(sample[0], graded, ["future", "episode_id"]).count() == 0


def test_checks(sample, spark):
    assert quality.missing_suggestions(sample[0]).first().violations == 0
    assert quality.missing_suggestions(states(spark, [("a", None), ("a", None)])).first().violations == 1
    assert quality.overlong_appends(sample[0]).first().violations == 0
    shrunk = states(spark, [("", None), ("", "x"), ("", None), ("abc", None), ("abc", "x"), ("b", None), ("bcd", None), ("b", "x"), ("", None)])
    assert quality.overlong_appends(shrunk).first().violations == 1
    assert quality.missing_code_ids(sample[0]).first().violations == 16


def test_audit_table(sample, spark):
    problems = spark.createDataFrame([("1", "A", "What?", "")], "contest_id string, question_id string, question_content string, starter_code string")
    rows = episodes.audit_table(*sample, problems).collect()
    assert {(r.episode_id, r.cycle, r.action, r.code_before, r.suggestion, r.code_after) for r in rows} == {
        (0, 0, "reject", "", "ab", "abc"),
        (1, 0, "accept", "x", "xy", "xyz"),
    }
    assert {r.problem for r in rows} == {"What?"}
    assert episodes.initial_states(problems).first().code == ""


def test_attach_code(spark):
    problems = spark.createDataFrame([("1", "A", "old"), ("2", "B", "old")], "contest_id string, question_id string, code string")
    codes = spark.createDataFrame([("1", "A", "# YOUR CODE HERE\nx = 1")], "contest_id string, question_id string, code string")
    assert [tuple(r) for r in curation.attach_code(problems, codes).collect()] == [
        ("1", "A", "x = 1"), ("2", "B", None),
    ]
    assert quality.unmatched_codes(problems, codes, ["contest_id", "question_id"]).first().violations == 1


def test_enrichment_keeps_every_episode(spark):
    steps = [("r", e, 0, step, f"code{step}", "s" if step == 1 else None) for e, n in ((1, 4), (2, 2), (3, 1)) for step in range(n)]
    trajectories = spark.createDataFrame(
        steps, "run_id string, episode_id long, future int, step int, code string, suggested_completion string"
    )
    infos = spark.createDataFrame([("r", 1, 0, 2, "accept")], "run_id string, episode_id long, future int, step int, action string")
    rows = sorted(tuple(r) for r in episodes.enrich_problems(trajectories, infos).collect())
    assert rows == [("r", 1, "s```", "code3", True), ("r", 2, "s```", "code1", None), ("r", 3, None, "code0", None)]


def test_datasets_keep_their_columns(sample, spark):
    dataset = spark.createDataFrame(
        [(0, "q0", "old", [1]), (1, "q1", "old", [2]), (9, "q9", "old", [3])],
        "episode_id long, question string, code string, input_ids_state array<int>",
    )
    rows = {r.episode_id: r for r in episodes.enrich_dataset(dataset, *sample).collect()}
    assert set(rows[0].asDict()) == {"episode_id", "question", "input_ids_state", "correct_completion", "code", "accepted"}
    assert (rows[0].question, rows[0].correct_completion, rows[0].code, rows[0].accepted) == ("q0", "ab```", "abc", False)
    assert rows[1].accepted is True and rows[9].code is None and rows[9].question == "q9"
    pairs = {r.episode_id: r for r in episodes.pair_dataset(dataset, sample[0]).collect()}
    assert set(pairs) == {0, 1} and set(pairs[0].asDict()) == {
        "episode_id", "question", "correct_completion", "next_state", "code",
    }
    assert pairs[0].code == ["abc"] and pairs[0].correct_completion == "ab"
    runs = dataset.withColumn("run_id", F.lit(7))
    assert episodes.enrich_dataset(runs, *sample).where("code IS NOT NULL").count() == 0
