import pytest
from pyspark.sql import functions as F

from tracemill import fixed_values as fixed
from tracemill.functions import prompts, text
from tracemill.operators import metrics


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("x = 1", "x = 1"),
        ("```python\nx = 1\n```", "\nx = 1\n"),
        ("```python\nx = 1", "\nx = 1"),
        ("  \n```\nx = 1\n```tail", "\nx = 1\n"),
        ("  ```x", "x"),
        ("x = 1```tail```", "x = 1"),
        ("```", ""),
        ("``````", ""),
        ("\x1c\u00a0```x", "x"),
        ("", ""),
        ("a```python b", "a b"),
        ("é🙂 = 1```", "é🙂 = 1"),
    ],
)
def test_clean_snippet(evaluate, given, wanted):
    assert evaluate(text.clean_snippet(F.col("s")), s=given) == wanted


def test_strip_is_unicode_aware(evaluate):
    assert evaluate(text.strip(F.col("s")), s=" \t Accept \n") == "Accept"
    given = "\x1c\u2003 x\x1f\n\n"
    assert evaluate(text.strip(F.col("s")), s=given) == given.strip()
    assert evaluate(text.normalise_token(F.col("s")), s=" ACCEPT\n") == "accept"


def test_prefix_and_suffix(evaluate):
    strip = text.strip_prefix(F.col("s"), fixed.CODE_PLACEHOLDER)
    assert evaluate(strip, s="# YOUR CODE HERE\nx") == "x"
    assert evaluate(strip, s="x# YOUR CODE HERE\n") == "x# YOUR CODE HERE\n"
    ending = text.strip_suffix(F.col("s"), "<|eot_id|>")
    assert evaluate(ending, s="a<|eot_id|>") == "a"
    assert evaluate(ending, s="<|eot_id|>") == ""
    assert evaluate(ending, s="<|eot_id|>a") == "<|eot_id|>a"


def test_tail_counts_code_points(evaluate):
    assert evaluate(text.suggested_tail(F.col("c"), F.col("s")), c="🙂", s="🙂ab") == "ab"
    assert evaluate(text.suggested_tail(F.col("c"), F.col("s")), c="abc", s="ab") == ""


@pytest.mark.parametrize("rating, bucket", [(999, "easy"), (1000, "medium"), (1999, "medium"), (2000, "hard")])
def test_difficulty(evaluate, rating, bucket):
    assert evaluate(text.difficulty(F.col("r")), r=rating) == bucket


def test_missing_rating_is_hard(evaluate):
    assert evaluate(text.difficulty(F.col("r")), schema="r int", r=None) == "hard"


@pytest.mark.parametrize("given", ["", "a", "a\n", "a\nb", "\n", "\n\n", "a\r\nb\r", "a\x0bb\x85c d"])
def test_lines(evaluate, given):
    assert evaluate(text.lines(F.col("s")), s=given) == given.splitlines()


def test_line_changes(spark):
    rows = spark.createDataFrame(
        [(1, "a\nb\nb", "a\nb\nc\nd"), (2, "", "x"), (3, "x", "x"), (4, "", "")], "id int, old string, new string"
    )
    got = metrics.line_changes(rows, ["id"], F.col("old"), F.col("new")).collect()
    assert {r.id: (r.added_lines, r.removed_lines) for r in got} == {1: (2, 1), 2: (1, 0), 3: (0, 0), 4: (0, 0)}


def test_question_prompt_branches(evaluate):
    question = prompts.question_text(F.col("q"), F.col("s"))
    assert "starter code" in evaluate(question, q="Q", s="def f():")
    assert "stdin" in evaluate(question, q="Q", s="")
    assert "stdin" in evaluate(question, schema="q string, s string", q="Q", s=None)


def test_assistant_answer_default(evaluate):
    plain = evaluate(prompts.assistant_prompt(F.col("c")), c="x = 1")
    assert [turn.role for turn in plain] == ["system"] + ["user", "assistant"] * 3
    assert plain[-1].content.endswith("x = 1")
    empty = evaluate(prompts.assistant_prompt(F.col("c"), F.lit("")), c="x = 1")
    assert empty[-1].content.endswith("```python\n")


def test_acceptor_needs_a_suggestion(evaluate):
    columns = [F.col(name) for name in ("q", "s", "c", "g", "d")]
    schema = "q string, s string, c string, g string, d string"
    turns = evaluate(prompts.acceptor_prompt(*columns, F.lit("because")), schema=schema, q="Q", s="", c="C", g="G", d="D")
    assert len(turns) == 7 and turns[-1].content == "Therefore, I would like to "
    with pytest.raises(Exception, match="acceptor needs a suggestion"):
        evaluate(prompts.acceptor_prompt(*columns), schema=schema, q="Q", s="", c="C", g=None, d="D")


def test_render_chat(evaluate):
    chat = F.array(prompts.message("user", F.col("c")), prompts.message("assistant", F.lit("ok")))
    closed = evaluate(prompts.render_chat(chat), c="hi")
    assert closed == (
        "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\nhi<|eot_id|>"
        "<|start_header_id|>assistant<|end_header_id|>\n\nok<|eot_id|>"
    )
    assert evaluate(prompts.render_chat(chat, "continue"), c="hi") == closed[: -len("<|eot_id|>")]
    assert evaluate(prompts.render_chat(chat, "generate"), c="hi").endswith("assistant<|end_header_id|>\n\n")
    with pytest.raises(ValueError):
        prompts.render_chat(chat, "other")
