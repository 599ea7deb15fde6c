import math

import pytest
from pyspark.sql import functions as F

from tracemill.operators import completions, decisions, examples, quality
from tracemill.operators.vocabulary import build_vocabulary, decode, encode


def decide(spark, *tokens):
    rows = spark.createDataFrame([(1, word, lp) for word, lp in tokens], "id int, token_text string, logprob double")
    return decisions.decide(rows, ["id"]).first()


def test_largest_summed_probability_wins(spark):
    row = decide(spark, (" Accept", math.log(0.3)), ("accept\n", math.log(0.3)), ("reject", math.log(0.4)), ("x", 0.0))
    assert row.action == "accept"
    assert math.isclose(row.accept_prob, 0.6) and math.isclose(row.logprob, math.log(0.6))


def test_ties_take_the_first_action(spark):
    assert decide(spark, ("accept", -1.0), ("reject", -1.0), ("finish", -1.0)).action == "accept"
    assert decide(spark, ("reject", -1.0), ("finish", -1.0)).action == "reject"
    assert decide(spark, ("reject", -2.0), ("finish", -1.0)).action == "finish"


def test_no_action_token_rejects(spark):
    row = decide(spark, ("maybe", -0.1))
    assert (row.action, row.accept_prob, row.logprob) == ("reject", 0.0, 0.0)


def test_token_maps_unfold(spark):
    infos = spark.createDataFrame([(1, {5: -0.5, 6: -1.0})], "id int, all_logprobs map<int,double>")
    assert {(r.token_id, r.logprob) for r in decisions.top_token_rows(infos, ["id"]).collect()} == {(5, -0.5), (6, -1.0)}


@pytest.fixture
def future_rows(spark):
    rows = [(1, [1, 2, 0], [[0.1, 0.5, 0.5], [0.2, 0.1, 0.0]], [1, 2, 3, 4, 5], [[1, 2, 7, 8, 9]])]
    df = spark.createDataFrame(
        rows,
        "example_id int, state_ids array<int>, q array<array<double>>, code_ids array<int>, null_ids array<array<int>>",
    )
    return completions.unravel_futures(df)


def test_choosers(future_rows):
    def pick(chooser, **options):
        chosen = completions.choose_completions(future_rows, chooser, 0, **options).collect()
        return {r.future: (r.chosen_ids, r.score_q, r.score_v) for r in chosen}

    mean = 1.4 / 6
    best = pick("empowerment")
    assert best[0][0] == [1, 2, 3, 4] and best[0][1] == 0.5 and math.isclose(best[0][2], mean)
    assert best[1][0] == [1, 2, 7] and best[1][1] == 0.2
    assert pick("longest", longest=2)[1][:2] == ([1, 2, 7, 8], 0.0)
    assert pick("shortest")[0][:2] == ([1, 2, 3], 0.0)
    for future, (ids, q, v) in pick("longest_random", longest=3).items():
        assert v == 0.0 and len(ids) == min(5, 3 - q)
    assert pick("random", longest=1)[0] == ([1, 2, 3], 0.1, pytest.approx(mean))
    with pytest.raises(ValueError):
        pick("best")


def test_weights(spark):
    rows = spark.createDataFrame(
        [("train", 1.0), ("train", 2.0), ("train", 3.0), ("test", 100.0), ("test", -100.0)], "split string, score_a double"
    )
    awr = [r.weight for r in completions.sample_weights(rows, "awr", 1.0).collect()]
    assert awr[1] == 1.0 and awr[3] == 100.0 and awr[4] == 0.01 and math.isclose(awr[2], math.e)
    wbc = [r.weight for r in completions.sample_weights(rows, "wbc", 2.0).collect()]
    assert wbc == [-0.5, 0.0, 0.5, 49.0, -51.0]
    assert {r.weight for r in completions.sample_weights(rows, "other", 1.0).collect()} == {1.0}
    flat = rows.withColumn("score_a", F.lit(2.0))
    for strategy in ("awr", "wbc"):
        assert {r.weight for r in completions.sample_weights(flat, strategy, 1.0).collect()} == {None}


def test_next_token_probabilities(spark):
    rows = spark.createDataFrame(
        [(1, 0, 0, [0.0, 1.0]), (1, 1, 1, [2.0, 2.0]), (1, 2, 0, [9.0, 0.0])],
        "example_id int, pos int, token_id int, logits array<float>",
    )
    probs = {r.pos: r.prob for r in completions.next_token_probabilities(rows, ["example_id"]).collect()}
    assert probs.keys() == {1, 2}
    assert math.isclose(probs[1], math.e / (1 + math.e)) and probs[2] == 0.5
    lengths = spark.createDataFrame([(1, 3, 1)], "example_id int, n_tokens int, remaining int")
    kept = completions.last_positions(completions.next_token_probabilities(rows, ["example_id"]), lengths, ["example_id"])
    assert [r.pos for r in kept.collect()] == [2]
    none = lengths.withColumn("remaining", F.lit(0))
    assert completions.last_positions(kept, none, ["example_id"]).count() == 0
    early = completions.next_token_probabilities(rows, ["example_id"], lengths=lengths)
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, kept.collect()))


@pytest.mark.parametrize("size, head_ranks", [(0, 0), (0, 2), (0, 1000), (1 << 20, 2)])
@pytest.mark.parametrize("own_texts", [True, False])
def test_vocabulary_round_trip(spark, monkeypatch, size, head_ranks, own_texts):
    from tracemill.operators import vocabulary as module

    monkeypatch.setattr(module, "BROADCAST_BYTES", size)
    monkeypatch.setattr(module, "HEAD_RANKS", head_ranks)
    docs = spark.createDataFrame(
        [(1, ["b", "a", "b", "c"]), (2, []), (3, ["b" * 300, "a"])], "id int, tokens array<string>"
    )
    table = build_vocabulary(docs.select(F.explode("tokens").alias("token")))
    assert [(r.token, r.frequency) for r in table.orderBy("token_id").collect()] == [
        ("a", 2), ("b", 2), ("b" * 300, 1), ("c", 1),
    ]
    coded = encode(docs, ["id"], "tokens", table, keep_tokens=True, own_texts=own_texts)
    rows = {r.id: r for r in coded.collect()}
    assert rows[1].ids == [2, 1, 2, 4] and rows[2].ids == [] and rows[3].ids == [3, 1]
    assert rows[1].tokens == ["b", "a", "b", "c"]
    closed = coded.select("id", F.array_append("ids", F.lit(0)).alias("ids"))
    text = {r.id: r.text for r in decode(closed, ["id"], "ids", table, special_ids=[0], own_texts=own_texts).collect()}
    assert text == {1: "babc", 2: "", 3: "b" * 300 + "a"}
    unknown = spark.createDataFrame([(1, ["zzz", "a"])], "id int, tokens array<string>")
    assert encode(unknown, ["id"], "tokens", table).first().ids == [None, 1]


def test_label_filters(spark):
    rows = spark.createDataFrame(
        [
            (1, [7, 8, 9], ["```python\nx", "y", "z"], [(0, 11), (12, 13), (14, 15)], "s" * 23),
            (2, [7, 8, 9], ["```python\nx", "y", "z"], [(0, 11), (12, 13), (14, 15)], "s" * 60),
        ],
        "id int, ids array<int>, tokens array<string>, spans array<struct<start:int,end:int>>, prompt string",
    )
    labelled = examples.label_by_offset(rows, "ids", "tokens", "spans", "prompt")
    got = {r.id: (r.labels, r.throwout, r.state) for r in labelled.collect()}
    assert got == {1: ([-100, -100, 9], False, "xy"), 2: ([-100, -100, -100], True, "s" * 60)}
    assert [r.id for r in examples.drop_throwouts(labelled).collect()] == [1]
    assert [r.id for r in examples.with_labels(labelled).collect()] == [1]
    assert examples.of_length(rows, "ids", 3).count() == 2 and examples.of_length(rows, "ids", 4).count() == 0


def test_example_checks(spark):
    rows = spark.createDataFrame(
        [([1, 2, 3], [-100, 2, 3], 1), ([1, 2], [-100, -100], 1), ([1, 2], [-100, 9], 1), ([1, 2], [1, 2], 1)],
        "input_ids array<int>, labels array<int>, masked int",
    )
    assert tuple(quality.bad_labels(rows, "masked").first()) == (4, 3)
    assert quality.wrong_lengths(rows, "input_ids", 2).first().violations == 1
    assert quality.wrong_lengths(rows, "input_ids", 2, exact=True).first().violations == 1
    assert quality.states_without_tokens(spark.createDataFrame([([0, 0],), ([1, 0],)], "s array<int>"), "s", 0).first().violations == 1
    decoded = spark.createDataFrame([(1, "```python\na"), (2, "b")], "id int, text string")
    expected = spark.createDataFrame([(1, "\na"), (2, "c")], "id int, code string")
    assert [r.id for r in quality.decode_mismatches(decoded, expected, ["id"]).collect()] == [2]
