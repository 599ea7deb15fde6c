"""Publishing tables and runs under composed names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def formatted_name(base: str) -> str:
    return f"{base}_f"


def threshold_name(base: str, threshold: float) -> str:
    return f"{base}{threshold}"


def fixed_length_name(base: str, tokens_after: int, sample: bool) -> str:
    return f"{base}_{tokens_after}_tok_after_state" + ("_sample" if sample else "")


def chooser_name(base: str, chooser: str) -> str:
    return f"{base}_f_{chooser}"


def tokenizer_name(base: str, tokenizer: str) -> str:
    return f"{base}_{tokenizer.rstrip('/').split('/')[-1]}"


def write_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Publish a table with one folder per split."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, NULL fields included; parent folders are made."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_run(
    spark: SparkSession,
    path: str,
    trajectories: DataFrame,
    infos: DataFrame,
    results: DataFrame,
    config: dict[str, str],
    mode: str = "errorifexists",
) -> None:
    """Histories, grades and settings of one run."""
    trajectories.write.mode(mode).partitionBy("run_id").parquet(f"{path}/trajectories")
    infos.write.mode(mode).partitionBy("run_id").parquet(f"{path}/infos")
    results.write.mode(mode).json(f"{path}/results")
    layout = T.StructType([T.StructField(name, T.StringType()) for name in config])
    spark.createDataFrame([tuple(config.values())], layout).coalesce(1).write.mode(mode).json(f"{path}/config")


def publish_run(
    spark: SparkSession,
    path: str,
    run_id: int,
    trajectories: DataFrame,
    infos: DataFrame,
    results: DataFrame,
    config: dict[str, str],
) -> None:
    """Put one run in place of what is published under its id, and leave all other runs alone.

    Every table lies in one folder per run, and only the run's own folders are
    replaced, so a job that is run again after a failure ends in the same state.
    Grades and settings carry the run's id like the histories. Rows of another
    run are an error, found before anything is written. A table without rows
    leaves what was published for the run as it was; its settings are replaced last.
    """
    layout = T.StructType([T.StructField(name, T.StringType()) for name in config])
    settings = spark.createDataFrame([tuple(config.values())], layout)
    tables = {"trajectories": trajectories, "infos": infos, "results": results, "config": settings.coalesce(1)}
    for name, df in tables.items():
        if "run_id" not in df.columns:
            tables[name] = df.withColumn("run_id", F.lit(run_id).cast("long"))
        elif not df.where(~F.col("run_id").eqNullSafe(F.lit(run_id))).isEmpty():
            raise ValueError(f"{name} holds rows of another run than {run_id}")
    for name, df in tables.items():
        writer = df.write.mode("overwrite").partitionBy("run_id").option("partitionOverwriteMode", "dynamic")
        if name in ("results", "config"):
            writer.option("ignoreNullFields", False).json(f"{path}/{name}")
        else:
            writer.parquet(f"{path}/{name}")


def unless_derived(name: str, suffix: str, build: Callable[[], DataFrame]) -> DataFrame | None:
    """Build a derived table unless ``name`` already is one; no plan is made then."""
    return None if name.endswith(suffix) else build()
