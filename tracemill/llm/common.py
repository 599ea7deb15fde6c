"""Helpers shared by the text operators: the shared folder, Arrow batches, row identity."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tracemill

# Workers get this package's functions by value and need no copy of it.
cloudpickle.register_pickle_by_value(tracemill)

#: Rows of text in one Arrow batch: batches of long texts stay within a worker's memory.
BATCH_ROWS = 256


#: Whether a query's shuffle files go as soon as it ends; else they stay until the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may be without it; it then gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = _local.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tracemill-shared-")
        _local[spark.sparkContext.applicationId] = named
    return named


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here.

    The written table survives lost executors. It is removed when the session's
    JVM ends. The shuffle files it was made from are not needed again and go at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tracemill-{uuid.uuid4().hex}/{name}"
    kept = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, kept)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in small Arrow batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def map_batches(
    df: DataFrame,
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | T.StructType,
) -> DataFrame:
    """``mapInArrow`` over small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string of longs, ints, strings, binaries, booleans and doubles."""
    kinds: dict[type, Any] = {
        T.LongType: pa.int64(),
        T.IntegerType: pa.int32(),
        T.StringType: pa.string(),
        T.BinaryType: pa.binary(),
        T.BooleanType: pa.bool_(),
        T.DoubleType: pa.float64(),
    }
    fields = []
    for part in ddl.split(","):
        name, kind = part.split()
        spark_type = T.StructType.fromDDL(f"x {kind}").fields[0].dataType
        fields.append(pa.field(name, kinds[type(spark_type)]))
    return pa.schema(fields)


def text_key(id_column: str = "doc_id", text: str = "text") -> Column:
    """Identity of a document row: its id and text. Rows equal in both are one document to it."""
    return F.concat_ws(
        ":",
        F.coalesce(F.col(id_column).cast("string"), F.lit("null")),
        F.lower(F.hex(F.xxhash64(F.col(text)))),
    )
