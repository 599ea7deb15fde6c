"""Table readers with declared schemas."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill import schemas
from tracemill.operators.grades import parse_errors, parse_graded


def read_all_splits(spark: SparkSession, path: str) -> DataFrame:
    """A published table with its ``split`` partition column."""
    return spark.read.parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; only its folder is listed and read."""
    return read_all_splits(spark, path).where(F.col("split") == split)


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Reader by suffix; a path without one is a published table."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix in (".json", ".jsonl"):
        return reader.option("multiLine", suffix == ".json").json(path)
    if suffix == ".csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if suffix in (".pkl", ".pickle"):
        raise ValueError("pickle runs code on load and is not read")
    return reader.parquet(path)


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRAJECTORIES).parquet(f"{path}/trajectories")


def read_infos(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.INFOS).parquet(f"{path}/infos")


def read_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Graded problems from a JSON array, or with ``multi_line=False`` one object per line."""
    return spark.read.schema(schemas.RESULTS).json(path, multiLine=multi_line)


def read_graded(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Graded problems with their lists and errors, malformed records included.

    ``multi_line`` reads one JSON array per file, of which a broken file is one
    malformed record; otherwise each line is an object. ``malformed`` holds the
    text of what could not be read, ``malformed_errors`` that of errors that are
    no record; both are null for good rows. Errors may be an object, or a string
    that holds one.
    """
    text = spark.read.text(path, wholetext=multi_line).select(F.col("value"))
    if multi_line:
        # Elements are kept as text first, so that one bad element does not spoil its file.
        parts = F.from_json("value", "array<string>")
        text = text.select(F.explode(F.coalesce(parts, F.array("value"))).alias("value"))
    else:
        text = text.where(F.trim("value") != "")
    rows = parse_graded(text, "value")
    return parse_errors(rows.select("graded.*", "malformed"), "errors")
