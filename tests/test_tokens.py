import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracemill.functions import arrays, tokens

INTS = "array<int>"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_scan_crosses_runs(spark):
    random = np.random.default_rng(1)
    rows = [(n, random.uniform(0.9, 1.0, n).tolist()) for n in (0, 1, 63, 64, 65, 500)]
    got = frame(spark, rows, "n int, p array<double>").select("n", "p", tokens.running_product(F.col("p")).alias("r"))
    for row in got.collect():
        assert row.r == np.cumprod(row.p).tolist() and len(row.r) == row.n


def test_products_agree_with_the_fold(spark):
    random = np.random.default_rng(2)
    rows = [(i, random.uniform(0.0, 1.0, random.integers(0, 90)).tolist()) for i in range(300)]
    rows += [(300 + i, [1.0, 0.0, 0.7][: i % 4] * i) for i in range(20)] + [(400, [])]
    df = frame(spark, rows, "n int, p array<double>").repartition(3)
    got = df.select(
        tokens.running_product(F.col("p")).alias("a"),
        tokens.folded_product(F.col("p")).alias("b"),
        tokens.likely_prefix_length(F.col("p"), 0.3).alias("c"),
        tokens.folded_prefix_length(F.col("p"), 0.3).alias("d"),
    ).collect()
    assert len(got) == len(rows)
    for row in got:
        assert len(row.a) == len(row.b) and np.allclose(row.a, row.b, rtol=0, atol=1e-12) and row.c == row.d


def test_products_of_nulls(spark):
    rows = [(1, [0.5, None, 0.5]), (2, None), (3, [0.5, 0.5]), (4, [None]), (5, [0.9]), (6, [])]
    df = frame(spark, rows, "n int, p array<double>").repartition(1)
    got = {
        r.n: (r.a, r.c)
        for r in df.select(
            "n", tokens.running_product(F.col("p")).alias("a"), tokens.likely_prefix_length(F.col("p"), 0.4).alias("c")
        ).collect()
    }
    assert got == {
        1: ([0.5, None, None], 1), 2: (None, None), 3: ([0.5, 0.25], 1), 4: ([None], 0), 5: ([0.9], 1), 6: ([], 0),
    }


def test_scan_keeps_zero(evaluate):
    assert evaluate(tokens.running_product(F.col("p")), p=[0.5, 0.0, 0.9]) == [0.5, 0.0, 0.0]


@pytest.mark.parametrize(
    "probs, threshold, kept",
    [([0.9, 0.9, 0.9], 0.8, 2), ([1.0, 1.0], 0.8, 2), ([0.8], 0.8, 1), ([0.0, 1.0], 0.8, 0), ([0.5, 0.9], 0.25, 2)],
)
def test_likely_prefix(evaluate, probs, threshold, kept):
    assert evaluate(tokens.likely_prefix_length(F.col("p"), threshold), p=probs) == kept


def test_empty_completion_keeps_the_state(evaluate):
    cut = tokens.likelihood_cut(F.col("s"), F.col("c"), F.col("p"))
    assert evaluate(cut, schema="s array<int>, c array<int>, p array<double>", s=[1, 2], c=[], p=[]) == [1, 2]


@pytest.mark.parametrize(
    "ids, probs, kept",
    [
        ([5, 6, 7], [0.9, 0.9, 0.5], [5, 6, 0]),
        ([5, 0, 7], [0.9, 0.9, 0.5], [5, 0]),
        ([5, 6], [1.0, 0.9], [5, 6]),
        ([5, 6], [0.8, 1.0], [0]),
        ([5], [0.1], [0]),
        ([], [], []),
    ],
)
def test_strict_cut(evaluate, ids, probs, kept):
    logprobs = F.transform(F.col("p"), F.ln)
    cut = tokens.strict_likelihood_cut(F.col("c"), logprobs, 0.8, 0)
    assert evaluate(cut, schema="c array<int>, p array<double>", c=ids, p=probs) == kept


@pytest.mark.parametrize(
    "state, code, others, full, kept",
    [
        ([1], [1, 2, 3, 4], [[1, 2, 9, 4]], False, [1, 2]),
        ([1], [1, 2, 3], [[1, 2]], False, [1, 2]),
        ([1], [1, 2, 3], [[1, 2, 3]], False, [1]),
        ([1], [1, 2, 3], [[1, 2, 3]], True, [1, 2, 3]),
        ([1, 2], [1, 2], [[7]], False, [1, 2]),
        ([1], [1, 2, 3], [[9, 2, 3, 4], [1, 2, 3]], False, [1]),
        ([1], [1, 2, 3], [[1, 2, 3], [1, 9, 3]], False, [1]),
    ],
)
def test_agreement(evaluate, state, code, others, full, kept):
    cut = tokens.agreement_cut(F.col("s"), F.col("c"), F.col("n"), full)
    schema = "s array<int>, c array<int>, n array<array<int>>"
    assert evaluate(cut, schema=schema, s=state, c=code, n=others) == kept


def test_fixed_and_random_length(spark):
    rows = frame(spark, [(i, [1, 2], list(range(1, 60))) for i in range(400)], "id int, s array<int>, c array<int>")
    cut = rows.select(
        F.size(tokens.fixed_length_cut(F.col("s"), F.col("c"))).alias("fixed"),
        (F.size(tokens.random_length_cut(F.col("s"), F.col("c"), 20, 3, F.col("id"))) - 2).alias("drawn"),
    ).collect()
    assert {row.fixed for row in cut} == {22}
    assert {row.drawn for row in cut} == set(range(1, 22))


def test_fixed_length_clips(evaluate):
    assert evaluate(tokens.fixed_length_cut(F.col("s"), F.col("c")), s=[1], c=[1, 2, 3]) == [1, 2, 3]


def test_random_prefix_is_proper(spark):
    rows = frame(spark, [(i, list(range(i % 5))) for i in range(200)], "id int, t array<int>")
    prefix = tokens.random_proper_prefix(F.col("t"), 1, F.col("id"))
    for row in rows.select("t", prefix.alias("p")).collect():
        assert row.p == row.t[: len(row.p)] and len(row.p) <= max(len(row.t) - 1, 0)


@pytest.mark.parametrize("ids, index", [([1, 2, 0, 0], 1), ([1, 0, 2], 2), ([0, 0], -1), ([], -1), ([3], 0)])
def test_last_non_eos(evaluate, ids, index):
    assert evaluate(tokens.last_non_eos_index(F.col("i"), 0), schema="i array<int>", i=ids) == index


def test_sampled_ids(evaluate):
    maps = F.array(
        F.create_map(F.lit(7), F.lit(-0.1), F.lit(8), F.lit(-2.0)), F.create_map(F.lit(9), F.lit(-0.5))
    )
    assert evaluate(tokens.append_sampled_ids(F.col("s"), maps), s=[1]) == [1, 7, 9]


def test_supervised_example(evaluate):
    built = tokens.supervised_example(F.col("p"), F.col("s"), F.col("c"), [90, 91], 99, 0, 12)
    row = evaluate(built, p=[1, 2], s=[3], c=[3, 4, 5])
    assert row.input_ids == [1, 2, 3, 4, 5, 90, 91, 99, 0, 0, 0, 0]
    assert row.labels == [-100, -100, -100, 4, 5, 90, 91, 99, -100, -100, -100, -100]
    assert row.attention_mask == [1] * 8 + [0] * 4


def test_long_example_is_left_whole(evaluate):
    row = evaluate(tokens.supervised_example(F.col("p"), F.col("s"), F.col("c"), [], 99, 0, 3), p=[1, 2], s=[3], c=[3, 4])
    assert row.input_ids == [1, 2, 3, 4, 99] and len(row.labels) == 5


def test_answer_example_checks_length(evaluate):
    built = tokens.answer_example(F.col("p"), F.col("a"), 9, 0, 4)
    assert evaluate(built, p=[1], a=[2, 3]).labels == [-100, 2, 3, 9]
    with pytest.raises(Exception, match="example too long"):
        evaluate(built, p=[1, 1], a=[2, 3])
    lenient = tokens.answer_example(F.col("p"), F.col("a"), 9, 0, 4, strict=False)
    assert evaluate(lenient, p=[1, 1], a=[2, 3]) is None and evaluate(lenient, p=[1], a=[2]).input_ids == [1, 2, 9, 0]


def test_offsets_and_corrected_state(evaluate):
    spans = evaluate(tokens.offset_spans(F.col("t")), t=["ab", "c", "🙂🙂"])
    assert [(s.start, s.end) for s in spans] == [(0, 2), (2, 3), (3, 5)]
    kept = tokens.kept_by_offset(F.col("s"), F.col("n"))
    schema = "s array<struct<start:int,end:int>>, n int"
    assert evaluate(kept, schema=schema, s=[(0, 5), (5, 12), (12, 20)], n=20) == [False, True, True]
    state = tokens.corrected_state(F.col("t"), F.col("k"))
    given = dict(t=["```python\na```", "x", "```python\nb", "c", "d"], k=[False, False, False, False, True])
    assert evaluate(state, **given) == "bc"
    assert evaluate(state, t=["a", "b"], k=[False, True]) is None


@pytest.mark.parametrize(
    "text, count",
    [
        ("def f(x):\n\tif x:\n\n\t\treturn x\n", 7),
        ("", 0),
        ("  \t\n", 1),
        ("a", 1),
        (" a\u00a0b\u2003c \r\n\x0b\x0c d  ", 3),
        ("🙂 $1 \\n \x00 \x1c", 5),
    ],
)
def test_tokens_are_the_text(evaluate, text, count):
    made = evaluate(tokens.tokenize(F.col("t")), t=text)
    assert len(made) == count and "".join(made) == text
    assert evaluate(tokens.detokenize(tokens.tokenize(F.col("t"))), t=text) == text


def test_softmax(evaluate):
    logits = [1.0, 2.0, 700.0, -5.0]
    weights = np.exp(np.array(logits) - 700.0)
    got = evaluate(tokens.softmax_at(F.col("l"), F.lit(1)), l=logits)
    assert np.isclose(got, (weights / weights.sum())[1])


def test_positions_do_not_descend(evaluate):
    assert evaluate(arrays.positions(F.lit(0))) == []
    assert evaluate(arrays.positions(F.lit(3))) == [0, 1, 2]


few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@few
@given(st.lists(st.lists(st.floats(0.01, 1.0), max_size=40), min_size=1, max_size=20))
def test_cuts_are_nested_prefixes(spark, rows):
    data = [(i, list(range(1, len(p) + 1)), p) for i, p in enumerate(rows)]
    lengths = frame(spark, data, "id int, c array<int>, p array<double>").select(
        "c",
        "p",
        tokens.likely_prefix_length(F.col("p"), 0.8).alias("high"),
        tokens.likely_prefix_length(F.col("p"), 0.3).alias("low"),
        tokens.strict_likelihood_cut(F.col("c"), F.transform("p", F.ln), 0.8, 0).alias("strict"),
    )
    for row in lengths.collect():
        reached = np.cumprod(row.p) >= 0.8
        assert row.high == reached.sum() and row.low >= row.high
        strict = [t for t in row.strict if t != 0]
        assert strict == row.c[: len(strict)] and len(strict) <= row.high + 1


@few
@given(st.lists(st.lists(st.integers(0, 50), max_size=12), min_size=1, max_size=20), st.integers(0, 15))
def test_unpad_undoes_pad(spark, rows, length):
    data = frame(spark, [(r,) for r in rows], "i array<int>")
    padded = tokens.right_pad(F.col("i"), -100, length)
    for row in data.select("i", padded.alias("p"), tokens.unpad(padded).alias("u")).collect():
        assert row.u == row.i and len(row.p) == max(len(row.i), length)
