"""Row filters and labelling of supervised examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill import fixed_values as fixed
from tracemill.functions.tokens import corrected_state, kept_by_offset, mask_labels


def label_by_offset(
    df: DataFrame, ids: str, tokens: str, spans: str, state_prompt: str
) -> DataFrame:
    """Add ``labels``, ``throwout`` and the corrected ``state`` from character offsets.

    A row without a label is flagged to be thrown out and keeps its state prompt.
    """
    kept = kept_by_offset(F.col(spans), F.length(state_prompt))
    return (
        df.withColumn("_kept", kept)
        .withColumn("labels", mask_labels(F.col(ids), F.col("_kept")))
        .withColumn("throwout", ~F.exists("_kept", lambda keep: keep))
        .withColumn(
            "state",
            F.when(F.col("throwout"), F.col(state_prompt)).otherwise(
                corrected_state(F.col(tokens), F.col("_kept"))
            ),
        )
        .drop("_kept")
    )


def drop_throwouts(df: DataFrame) -> DataFrame:
    return df.where(~F.col("throwout"))


def with_labels(df: DataFrame, labels: str = "labels") -> DataFrame:
    return df.where(F.exists(labels, lambda label: label != fixed.IGNORED_LABEL))


def of_length(df: DataFrame, column: str = "attention_mask", length: int = fixed.PAD_LENGTH) -> DataFrame:
    return df.where(F.size(column) == length)
