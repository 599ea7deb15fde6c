"""The composed training table against a plain construction, row by row."""

import re

import pytest
from pyspark.sql import functions as F

from tracemill import fixed_values as fixed
from tracemill.functions.prompts import assistant_prompt, render_chat
from tracemill.operators import decisions, training, vocabulary

LENGTH = 330
ROWS = [
    (1, "x = 1\n", "x = 1\nfor i in y:\n  pass```", "kept"),
    (2, "", "print()```", "kept"),
    (3, "same text", "same text", "kept"),
    (4, "long " * 300, "long " * 300 + "more```", "kept"),
    (5, None, "a ```python\nb c", "kept"),
    (6, "x y", None, "kept"),
    (7, "é ü\n", "é ü\n" + "ß " * 200 + "```", "kept"),
    (8, "a ```python\nb", "a ```python\nb c d e```", None),
]


def plain(spark, rows, known, length):
    """The training table's rows by Python loops, from the rendered chats."""
    made = {}
    for key, response, template in rows:
        tokens = re.findall(r"[\t\n\x0b\x0c\r ]*[^\t\n\x0b\x0c\r ]+|[\t\n\x0b\x0c\r ]+\Z", response)
        assert "".join(tokens) == response
        cutoff, end, ids, labels, start = len(template) - 10, 0, [], [], None
        for token in tokens[:length]:
            end += len(token)
            kept = cutoff < end - 1
            if kept and start is None:
                start = end - len(token)
            ids.append(known[token])
            labels.append(known[token] if kept else -100)
        state = template
        if start is not None:
            before = response[:start]
            state = before.rsplit("```python\n", 1)[1] if "```python\n" in before else None
        mask = [1] * len(ids) + [0] * (length - len(ids))
        pads = length - len(ids)
        made[key] = (start is None, state, ids + [9] * pads, labels + [-100] * pads, mask)
    return made


@pytest.mark.parametrize("limit", [vocabulary.BROADCAST_BYTES, 0])
def test_against_a_plain_construction(spark, monkeypatch, limit):
    """In the row, and by join where the vocabulary is too large."""
    monkeypatch.setattr(vocabulary, "BROADCAST_BYTES", limit)
    df = spark.createDataFrame(ROWS, "doc_id long, state string, correct_completion string, extra string")
    rows = training.format_examples(df)
    known = vocabulary.build_vocabulary(training.response_tokens(rows))
    ids = {r.token: r.token_id for r in known.collect()}
    chats = [tuple(r) for r in rows.select("doc_id", training.RESPONSE, training.TEMPLATE).collect()]
    want = plain(spark, chats, ids, LENGTH)
    made = training.tokenize_examples(rows, known, ["doc_id"], 9, LENGTH)
    assert made.columns == [*rows.columns, "throwout", "input_ids", "labels", "attention_mask"]
    got = {r.doc_id: (r.throwout, r.state, r.input_ids, r.labels, r.attention_mask) for r in made.collect()}
    assert got == want
    assert [key for key, row in want.items() if row[0]] == [4] and want[5][1] == "a"
    table = training.training_table(rows, known, ["doc_id"], 9, LENGTH)
    assert sorted(r.doc_id for r in table.collect()) == [1, 2, 3, 5, 6, 7, 8]
    assert training.training_table(rows.limit(0), known, ["doc_id"], 9, LENGTH).count() == 0


@pytest.mark.parametrize("own_texts", [True, False])
def test_rare_tokens_meet_by_join_and_texts_stay(spark, monkeypatch, own_texts):
    """Past the broadcast size: rows of repeated and null keys come back one for one, and no text is shuffled."""
    rows = [(key, *row[1:]) for key, row in zip([1, 1, None, None, 5, 5, 7, 8], ROWS)] + [(None, *ROWS[0][1:])]
    df = spark.createDataFrame(rows, "doc_id long, state string, correct_completion string, extra string")
    rows = training.format_examples(df)
    known = vocabulary.build_vocabulary(training.response_tokens(rows))
    want = training.tokenize_examples(rows, known, ["doc_id"], 9, LENGTH).drop(training.TEMPLATE, training.RESPONSE)
    monkeypatch.setattr(vocabulary, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vocabulary, "HEAD_RANKS", 20)
    got = training.tokenize_examples(rows, known, ["doc_id"], 9, LENGTH, own_texts)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    plan = got.select("throwout", "labels")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") and not any(training.RESPONSE in x for x in plan.split("\n") if "Exchange" in x)


def test_a_missing_completion_is_the_state(spark):
    df = spark.createDataFrame([(1, "x", None)], "doc_id long, state string, correct_completion string")
    row = training.format_examples(df).first()
    assert row[training.RESPONSE] == row[training.TEMPLATE]
    want = df.select(render_chat(assistant_prompt(F.col("state"))).alias("t")).first().t
    assert row[training.TEMPLATE] == want


def test_lookup_in_the_row(spark):
    known = spark.createDataFrame([("a", 5), (" b", 2), ("é", 9)], "token string, token_id int")
    df = spark.createDataFrame(
        [(1, ["a", " b", "?", None, "é"]), (2, []), (3, None), (4, ["a"] * 3)], "k int, tokens array<string>"
    ).repartition(1)
    rows = vocabulary.encode(df, ["k"], "tokens", known, keep_tokens=True)
    got = {r.k: (r.ids, r.tokens) for r in rows.collect()}
    assert got == {
        1: ([5, 2, None, None, 9], ["a", " b", "?", None, "é"]), 2: ([], []), 3: ([], []), 4: ([5] * 3, ["a"] * 3),
    }
    back = vocabulary.decode(rows, ["k"], "ids", known, special_ids=[2])
    assert {r.k: r.text for r in back.collect()} == {1: "aé", 2: "", 3: "", 4: "aaa"}
    # Rows come back one for one, repeated keys too, and a slice of a batch keeps its own items.
    twice = df.union(df).where("k <> 2").repartition(1)
    assert vocabulary.encode(twice, ["k"], "tokens", known).count() == 6


def test_tokens_meet_by_join_past_the_broadcast_size(spark, monkeypatch):
    monkeypatch.setattr(vocabulary, "BROADCAST_BYTES", 0)
    known = spark.createDataFrame([("a", 5), (" b", 2)], "token string, token_id int")
    df = spark.createDataFrame([(1, ["a", " b", "?"]), (2, [])], "k int, tokens array<string>")
    rows = vocabulary.encode(df, ["k"], "tokens", known)
    assert {r.k: r.ids for r in rows.collect()} == {1: [5, 2, None], 2: []}
    assert {r.k: r.text for r in vocabulary.decode(rows, ["k"], "ids", known).collect()} == {1: "a b", 2: ""}


@pytest.mark.parametrize("limit", [decisions.ACTION_IDS, 0])
def test_decision_from_a_map(spark, monkeypatch, limit):
    """Read in the row, and by join where too many ids read as an action."""
    monkeypatch.setattr(decisions, "ACTION_IDS", limit)
    known = spark.createDataFrame(
        [(" Accept", 1), ("accept", 2), ("REJECT\n", 3), ("finish", 4), ("acceptable", 5), ("the", 6)], "token string, token_id int"
    )
    maps = [
        (1, {1: -2.0, 2: -1.0, 3: -0.9, 6: -0.1}),
        (2, {3: -1.0, 4: -1.0, 99: 0.0}),
        (3, {5: -0.1, 6: -0.2}),
        (4, {}),
        (5, None),
        (6, {4: -0.5, 1: None}),
        (7, {2: -1.0, 4: -1.0}),
    ]
    infos = spark.createDataFrame(maps, "k int, all_logprobs map<int,double>")
    got = {r.k: r for r in decisions.decide_from_logprobs(infos, known, ["k"]).collect()}
    assert {k: r.action for k, r in got.items()} == {1: "accept", 2: "reject", 3: "reject", 4: "reject", 6: "finish", 7: "accept"}
    assert got[3].accept_prob == 0 and got[3].logprob == 0 and got[7].accept_prob == pytest.approx(0.5)
    text = infos.where("k <= 3").select("k", F.explode("all_logprobs").alias("token_id", "logprob")).join(known, "token_id")
    for r in decisions.decide(text, ["k"], "token").collect():
        assert r.action == got[r.k].action
        assert r.accept_prob == pytest.approx(got[r.k].accept_prob)
        assert r.logprob == pytest.approx(got[r.k].logprob)


def test_fixed_length_of_the_marker():
    assert fixed.END_OF_TURN_LENGTH == len(fixed.CHAT_END_OF_TURN)
