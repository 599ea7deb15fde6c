"""Declared table layouts. Every table carries explicit keys; nothing is joined by position."""

from __future__ import annotations

from pyspark.sql import types as T

EPISODE_KEY = ("run_id", "future", "episode_id")
PROBLEM_KEY = ("contest_id", "question_id")

_key_fields = [
    T.StructField("run_id", T.LongType()),
    T.StructField("future", T.IntegerType()),
    T.StructField("episode_id", T.LongType()),
]

PROBLEMS = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "question_title",
            "question_content",
            "platform",
            "question_id",
            "contest_id",
            "contest_date",
            "starter_code",
            "difficulty",
            "public_test_cases",
            "private_test_cases",
            "metadata",
        )
    ]
)

TRAJECTORIES = T.StructType(
    _key_fields
    + [
        T.StructField("step", T.LongType()),
        T.StructField("contest_id", T.StringType()),
        T.StructField("question_id", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("suggested_completion", T.StringType()),
        T.StructField("code_iids", T.ArrayType(T.IntegerType())),
    ]
)

INFOS = T.StructType(
    _key_fields
    + [
        T.StructField("step", T.LongType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("accept_prob", T.DoubleType()),
        T.StructField("action", T.StringType()),
        T.StructField("logprob", T.DoubleType()),
        T.StructField("all_logprobs", T.MapType(T.IntegerType(), T.DoubleType())),
        T.StructField("action_text_raw", T.StringType()),
    ]
)

RESULTS = T.StructType(
    [
        T.StructField("episode_id", T.LongType()),
        T.StructField("pass@1", T.DoubleType()),
    ]
)

#: Grades of one problem as a grader writes them; ``_corrupt`` takes text that is no such record.
CORRUPT = "_corrupt"

ERRORS = T.StructType(
    [
        T.StructField("error", T.StringType()),
        T.StructField("error_code", T.IntegerType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("inputs", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("expected", T.StringType()),
        T.StructField(CORRUPT, T.StringType()),
    ]
)

GRADED = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("future", T.IntegerType()),
        T.StructField("episode_id", T.LongType()),
        T.StructField("contest_id", T.StringType()),
        T.StructField("question_id", T.StringType()),
        T.StructField("output_list", T.ArrayType(T.StringType())),
        T.StructField("code_list", T.ArrayType(T.StringType())),
        T.StructField("graded_list", T.ArrayType(T.BooleanType())),
        T.StructField("pass@1", T.DoubleType()),
        T.StructField("errors", T.StringType()),
        T.StructField(CORRUPT, T.StringType()),
    ]
)

CHAT = T.ArrayType(
    T.StructType(
        [
            T.StructField("role", T.StringType()),
            T.StructField("content", T.StringType()),
        ]
    )
)

SUPERVISED = T.StructType(
    [
        T.StructField("input_ids", T.ArrayType(T.IntegerType())),
        T.StructField("labels", T.ArrayType(T.IntegerType())),
        T.StructField("attention_mask", T.ArrayType(T.IntegerType())),
    ]
)
