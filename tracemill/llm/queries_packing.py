"""The query that packs all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import packing
from tracemill.llm.registry import query, table


def with_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query("op10_lexical_packing")
def lexical_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every document, with its window."""
    return with_digest(packing.pack(table(spark, sf, "documents").select("doc_id", "text")))
