"""Metrics per cycle against a replay of the histories, cycle by cycle."""

import random

import pytest

from tests.test_episodes import states
from tracemill import schemas
from tracemill.operators import metrics, scale


def replay(histories, rows, after):
    """For every cycle, the latest info of every episode, looked at ``after`` steps into the cycle."""
    given = {(episode, step): values for episode, step, *values in rows}
    ends = []
    for episode, history in enumerate(histories):
        last = len(history) - 1
        for step in range(1, len(history)):
            if step % 3 == 2 and given.get((episode, step), [None])[0] == "finish":
                last = step
            elif step % 3 == 0 and history[step][0] == history[step - 1][0]:
                last = step
            else:
                continue
            break
        ends.append(last)
    cycles = max((last + 2) // 3 for last in ends)
    nothing = (None, None, None)
    return [
        [given.get((episode, min(last, 3 * cycle + after)), nothing) for episode, last in enumerate(ends)]
        for cycle in range(cycles)
    ]


def check(spark, histories, rows, moment="acceptor"):
    trajectories = states(spark, *histories)
    infos = spark.createDataFrame(
        [(0, 0, e, s, "why", prob, action, logprob, None, None) for e, s, action, prob, logprob in rows], schemas.INFOS
    )
    latest = replay(histories, rows, metrics.MOMENTS[moment])
    if moment == "acceptor":
        got = {r.cycle: r for r in metrics.action_ratios_per_cycle(trajectories, infos).collect()}
        assert sorted(got) == list(range(len(latest)))
        for cycle, infos_now in enumerate(latest):
            actions = [action for action, _, _ in infos_now if action is not None]
            assert (got[cycle].episodes, got[cycle].with_action) == (len(histories), len(actions))
            for action in ("accept", "append", "finish", "reject"):
                share = actions.count(action) / len(actions) if actions else None
                assert got[cycle][f"{action}_ratio"] == (share if share is None else pytest.approx(share))
    means = {r.cycle: r for r in metrics.numeric_means_per_cycle(trajectories, infos, moment).collect()}
    for cycle, infos_now in enumerate(latest):
        for place, name in ((1, "mean_accept_prob"), (2, "mean_logprob")):
            values = [info[place] for info in infos_now if info[place] is not None]
            mean = sum(values) / len(values) if values else None
            assert means[cycle][name] == (mean if mean is None else pytest.approx(mean))


def history(steps, stops_at=None):
    """Code that grows at every append but the one it stops at."""
    out, code = [("", None)], ""
    for step in range(1, steps):
        if step % 3 == 0 and step != stops_at:
            code += "x"
        out.append((code, code + "y" if step % 3 == 1 else None))
    return out


@pytest.mark.parametrize("moment", list(metrics.MOMENTS))
def test_random_histories(spark, moment):
    pick = random.Random(moment)
    histories = [history(pick.randrange(1, 24), pick.choice([None, 3, 6, 12])) for _ in range(25)]
    rows = [
        (e, s, pick.choice(["accept", "reject", "append", "finish", None]), pick.choice([0.25, 0.5, None]), -pick.random())
        for e, whole in enumerate(histories)
        for s in range(1, len(whole))
        # Some steps have no info at all, some appends have one, and infos go on past the end.
        if pick.random() < (0.9 if s % 3 == 2 else 0.2)
    ]
    check(spark, histories, rows, moment)


def test_an_episode_that_stopped_2000_cycles_ago(spark):
    histories = [history(6_010), history(9), history(5), history(40, stops_at=33)]
    rows = [(0, s, "reject", 0.5, -1.0) for s in range(2, 6_010, 3)]
    rows += [(1, 2, "reject", 0.1, -2.0), (1, 5, "accept", 0.2, -3.0), (1, 8, "finish", 0.9, -0.1), (2, 2, "accept", 0.7, None)]
    rows += [(3, s, "accept", 0.3, -4.0) for s in range(2, 40, 3)]
    check(spark, histories, rows)


def test_blocks_of_few_steps(spark, monkeypatch):
    for function in (scale.with_group_values, scale.with_running):
        defaults = tuple(4 if value == scale.BLOCK else value for value in function.__defaults__)
        monkeypatch.setattr(function, "__defaults__", defaults)
    histories = [history(60), history(9), history(30, stops_at=15)]
    rows = [(e, s, "accept" if e else "reject", 0.5, -1.0) for e, whole in enumerate(histories) for s in range(2, len(whole), 3)]
    check(spark, histories, rows)


def test_edges(spark):
    trajectories, infos = states(spark, [("a", None)]), spark.createDataFrame([], schemas.INFOS)
    assert metrics.action_ratios_per_cycle(trajectories, infos).count() == 0
    assert metrics.action_ratios_per_cycle(trajectories.limit(0), infos).count() == 0
    with pytest.raises(ValueError):
        metrics.latest_per_cycle(trajectories, infos, {}, "never")
    only = metrics.action_ratios_per_cycle(states(spark, history(7)), infos).orderBy("cycle").collect()
    assert [(r.cycle, r.with_action, r.accept_ratio) for r in only] == [(0, 0, None), (1, 0, None)]
