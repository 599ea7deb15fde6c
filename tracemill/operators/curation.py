"""Raw problem tables to curated problem tables, and reproducible subsets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import fixed_values as fixed
from tracemill.functions.text import difficulty, strip_prefix
from tracemill.functions.tokens import seeded_hash, seeded_int
from tracemill.operators.scale import first_per_key, hash_quota, take_by_hash, take_first
from tracemill.schemas import PROBLEM_KEY, PROBLEMS


def rename_raw(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(
        {"name": "question_title", "index": "question_id", "contestId": "contest_id"}
    )


def add_constants(df: DataFrame, contest_date: str) -> DataFrame:
    """Columns that are the same for each problem; the date is given, not read off the clock."""
    return df.withColumns(
        {
            "platform": F.lit(fixed.PLATFORM),
            "contest_date": F.lit(contest_date),
            "starter_code": F.lit(""),
            "public_test_cases": F.lit(fixed.EMPTY_CASES),
            "private_test_cases": F.lit(fixed.EMPTY_CASES),
            "metadata": F.lit(fixed.EMPTY_CASES),
        }
    )


def add_difficulty(df: DataFrame, rating: str = "rating") -> DataFrame:
    return df.withColumn("difficulty", difficulty(F.col(rating)))


def add_question_content(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "question_content",
        F.concat("`problem-description`", "`input-specification`", "`output-specification`"),
    )


def select_problem_columns(df: DataFrame) -> DataFrame:
    return df.select(*PROBLEMS.fieldNames())


def concatenate_splits(splits: Mapping[str, DataFrame]) -> DataFrame:
    """Stack named splits into one table that keeps the split name."""
    named = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    whole = named[0]
    for other in named[1:]:
        whole = whole.unionByName(other)
    return whole


def deduplicate_problems(df: DataFrame, order: str = "ordinal") -> DataFrame:
    return first_per_key(df, ["contestId", "index"], order)


def format_problems(df: DataFrame, contest_date: str) -> DataFrame:
    """Deduplicated raw rows to the problem layout."""
    return (
        df.transform(rename_raw)
        .transform(add_constants, contest_date)
        .transform(add_difficulty)
        .transform(add_question_content)
        .transform(select_problem_columns)
    )


def drop_if_present(df: DataFrame, names: Sequence[str] = fixed.OUTDATED_COLUMNS) -> DataFrame:
    return df.drop(*names)


def drop_derived(df: DataFrame) -> DataFrame:
    """Drop model-side columns by name, keeping source columns."""
    return df.select(
        *[
            F.col(f"`{name}`")
            for name in df.columns
            if name not in fixed.DERIVED_NAMES
            and not any(part in name for part in fixed.DERIVED_SUBSTRINGS)
        ]
    )


def conform_problems(df: DataFrame) -> DataFrame:
    """Bring any problem table to the declared columns, defaulting what may be missing."""
    defaults = {
        "public_test_cases": fixed.EMPTY_CASES,
        "private_test_cases": fixed.EMPTY_CASES,
        "metadata": fixed.EMPTY_METADATA,
    }
    missing = {name: F.lit(text) for name, text in defaults.items() if name not in df.columns}
    whole = df.withColumns(missing) if missing else df
    return whole.select(*[F.col(field.name).cast(field.dataType) for field in PROBLEMS]).to(PROBLEMS)


def head_of_splits(
    df: DataFrame, order: str, train_size: int, test_fraction: float = fixed.TEST_FRACTION
) -> DataFrame:
    """First rows of the train and test splits, other splits whole; a size of 0 keeps everything.

    ``order`` is unique within a split; rows that tie with the last one stay too.
    """
    if train_size == 0:
        return df
    train = take_first(df.where(F.col("split") == "train"), [order], train_size)
    test = take_first(df.where(F.col("split") == "test"), [order], int(train_size * test_fraction))
    others = df.where(~F.coalesce(F.col("split").isin("train", "test"), F.lit(False)))
    return train.unionByName(test).unionByName(others)


def from_date(df: DataFrame, column: str, start: str) -> DataFrame:
    return df.where(F.col(column) >= F.lit(start).cast(df.schema[column].dataType))


def sort_problems(df: DataFrame) -> DataFrame:
    return df.orderBy("question_id", "contest_id")


def shuffle_and_take(df: DataFrame, keys: Sequence[str], seed: int, count: int) -> DataFrame:
    """A seeded random subset of exactly ``count`` rows; 0 keeps all."""
    return df if count == 0 else take_by_hash(df, keys, seed, F.lit(count))


def split_by_hash(
    df: DataFrame, keys: Sequence[str], seed: int, test_fraction: float = fixed.TEST_FRACTION
) -> DataFrame:
    """Add ``split`` by comparing a hash with the fraction: no count, no shuffle."""
    scale = 1_000_000
    share = seeded_int(scale, seed, *[F.col(key) for key in keys])
    return df.withColumn("split", F.when(share < int(test_fraction * scale), "test").otherwise("train"))


def split_exactly(
    df: DataFrame, keys: Sequence[str], seed: int, test_fraction: float = fixed.TEST_FRACTION
) -> DataFrame:
    """Add ``split`` with exactly the ceiling of ``test_fraction`` of the rows in test."""
    last = hash_quota(df, keys, seed, F.ceil(F.col("total") * test_fraction)).scalar()
    mine = seeded_hash(seed, *[F.col(key) for key in keys])
    return df.withColumn("split", F.when(F.coalesce(mine <= last, F.lit(False)), "test").otherwise("train"))


def test_quota(test_split: float, count: int, train_rows: Column) -> Column:
    """How many test rows go with ``count`` training rows, truncated to an integer."""
    asked = train_rows if count == 0 else F.least(F.lit(count), train_rows)
    return F.floor(asked * F.lit(test_split))


def attach_code(problems: DataFrame, codes: DataFrame) -> DataFrame:
    """Put rollout code on its problem by key, without the leading placeholder line.

    Every problem stays, without code if it has none; two codes for one problem are an error.
    """
    cleaned = (
        codes.groupBy(*PROBLEM_KEY)
        .agg(F.min("code").alias("code"), F.count("*").alias("_codes"))
        .select(
            *PROBLEM_KEY,
            F.when(F.col("_codes") == 1, strip_prefix(F.col("code"), fixed.CODE_PLACEHOLDER))
            .otherwise(F.raise_error(F.lit("a problem has more than one code")))
            .alias("code"),
        )
    )
    return problems.drop("code").join(cleaned, [*PROBLEM_KEY], "left")
