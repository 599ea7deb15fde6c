"""Running the caller's Python over columns in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tracemill
from tracemill import fixed_values as fixed

# Functions of this package travel by value, so workers need not have it installed.
cloudpickle.register_pickle_by_value(tracemill)


def map_rows(
    df: DataFrame, function: Callable, inputs: Sequence[str], output: str, kind: str | T.DataType, **bound
) -> DataFrame:
    """Add ``output`` by a Python function of some columns and bound arguments."""

    @F.pandas_udf(kind)
    def apply(*columns: pd.Series) -> pd.Series:
        return pd.Series([function(*values, **bound) for values in zip(*columns)], index=columns[0].index)

    return df.withColumn(output, apply(*[F.col(name) for name in inputs]))


def map_batches(
    df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType, batch_rows: int
) -> DataFrame:
    """Replace the table by a Python function of frames of at most ``batch_rows`` rows."""

    def apply(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_rows):
                yield function(frame.iloc[start : start + batch_rows].reset_index(drop=True))

    return df.mapInPandas(apply, schema)


def filter_by_key(df: DataFrame, flags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep rows whose key is flagged true; a key stands in for a row number."""
    return df.join(flags.where("flag").select(*keys), [*keys], "left_semi")


def map_by_key(df: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the values kept under each row's key."""
    return df.join(values, [*keys], "left")


def generate(
    df: DataFrame,
    prompt: str,
    output: str,
    function: Callable[[list[str]], list[str]],
    clients: int | None = None,
    attempts: int = fixed.GENERATION_ATTEMPTS,
) -> DataFrame:
    """Call ``function`` on batches of prompts from ``clients`` partitions, retrying a failed batch.

    Without a number there are as many clients as the cluster has cores, so calls grow with it.
    """
    clients = clients or df.sparkSession.sparkContext.defaultParallelism
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.StringType())])

    def call(prompts: list[str]) -> list[str]:
        for attempt in range(attempts):
            try:
                return function(prompts)
            except Exception:
                if attempt + 1 == attempts:
                    raise
        raise ValueError("attempts must be positive")

    def apply(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{output: call(frame[prompt].tolist())})

    return df.repartition(clients).mapInPandas(apply, schema)
