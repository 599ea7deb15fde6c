"""What filters do to each other: every order of them, from counts per set of failures.

A document's failures are a mask of five bits. Counts of masks are additive, so
all orders of the filters follow from at most 32 counts per part of the corpus
and no document is looked at per order.

Whether a text repeats is asked of a counting Bloom filter first. Texts it
proves to be unique never leave their task; only possible repeats are shuffled,
whole, and grouped by their full text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import map_batches, stage
from tracemill.llm.sketch import Screen

#: Filters by letter; a document that fails the i-th has bit i of its mask set.
FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_UPPER_PERCENT = 5
SYMBOLS = b"#$%&*|"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
REPEAT_BIT = 16


def mask_of(text: bytes, points: int) -> int:
    """Failures A to D of a text of so many code points."""
    words = text.split()
    return (
        (len(words) < LEAST_WORDS)
        + 2 * (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words))
        + 4 * (100 * (len(text) - len(text.translate(None, _UPPER))) > MOST_UPPER_PERCENT * points)
        + 8 * (len(text) != len(text.translate(None, SYMBOLS)))
    )


def _digest(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def text_masks(docs: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """``doc_id, part, mask, x, y`` of every row: failures A to D, and two digests of the text."""
    content = F.coalesce(F.col(text), F.lit(""))
    x, y = _digest(content)
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        x.alias("x"),
        y.alias("y"),
        content.alias("text"),
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(4)
            masks = [
                mask_of(value, points)
                for value, points in zip(texts.cast(pa.binary()).to_pylist(), pc.utf8_length(texts).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(masks, pa.int32())], names=["doc_id", "part", "x", "y", "mask"]
            )

    schema = T.StructType([*narrow.schema.fields[:4], T.StructField("mask", T.IntegerType())])
    return map_batches(narrow, measure, schema)


def document_masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``doc_id, part, mask`` of every row of ``docs``: which of the five filters it fails.

    A: under 50 words. B: distinct words under 65 % of words. C: A-Z over 5 % of
    code points. D: holds one of ``#$%&*|``. E: its text is that of a row with a
    smaller id, wherever that row is and whatever befalls it. Null texts are
    empty texts and a null part is the empty string. Rows of one id, even equal
    ones, do not repeat each other; a null id is smaller and greater than none.
    Other columns of ``docs`` are not looked at, whatever their names.
    """
    rows = stage(text_masks(docs, doc_id, text, part), "masks")
    screen = Screen(rows, ["x", "y"])
    content = F.coalesce(F.col(text), F.lit(""))
    x, y = _digest(content)
    texts = docs.select(F.col(doc_id).alias("doc_id"), content.alias("text"), x.alias("x"), y.alias("y"))
    # Copies within a task are one row before the shuffle, so a text of any number of copies is a few rows.
    classes = (
        texts.where(screen.may_repeat(F.col("x"), F.col("y")))
        .groupBy("text", "x", "y")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .where("least < most")
        .select("x", "y", "least")
    )
    classes = stage(classes, "repeats")
    maybe = screen.may_repeat(F.col("x"), F.col("y"))
    repeats = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int") * REPEAT_BIT
    judged = (
        rows.where(maybe)
        .join(classes, ["x", "y"], "left")
        .select("doc_id", "part", (F.col("mask") + repeats).alias("mask"))
    )
    return rows.where(~maybe).select("doc_id", "part", "mask").union(judged)


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of every set of failures, 32 at most per part.

    A document is good or toxic if any label row of its id says 1; ids without
    one, and null ids, are neither.
    """
    marks = (
        labels.groupBy("doc_id")
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
        .where("good = 1 OR toxic = 1")
    )
    return (
        masks.join(marks, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"),
            F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("toxic"),
        )
    )


def _bit(letter: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), letter) - 1)


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counts of ``mask_counts``.

    ``kept`` after the step, ``removed`` at it, ``redundant`` failures already
    gone, ``unique_fails`` that fail nothing else, good and toxic documents lost
    at the step, and ``shapley``: what the step's filter removes, over all orders.
    """
    orders = F.array(*[F.lit("".join(order)) for order in permutations(FILTERS)])
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    steps = (
        parts.select("part", "masks", F.explode(orders).alias("filter_order"))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("own", _bit(F.substring("filter_order", F.col("step"), F.lit(1))))
        .withColumn(
            "before",
            F.aggregate(
                F.slice(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(1), F.col("step") - 1),
                F.lit(0),
                lambda done, i: done.bitwiseOR(_bit(F.substring(F.col("filter_order"), i, F.lit(1)))),
            ),
        )
    )

    def total(value, condition) -> Column:
        return F.aggregate(F.filter("masks", condition), F.lit(0).cast("long"), lambda done, m: done + value(m))

    def n(m: Column) -> Column:
        return m["n"]

    own, before = F.col("own"), F.col("before")
    fails = lambda m: m["mask"].bitwiseAND(own) != 0
    gone = lambda m: m["mask"].bitwiseAND(before) != 0
    removed = lambda m: fails(m) & ~gone(m)
    #: A filter is the first of a mask's k failures in one of k orders.
    everywhere = 120
    share = lambda m: m["n"] * F.call_function("div", F.lit(everywhere), F.bit_count(m["mask"]))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(n, lambda m: m["mask"].bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total(n, removed).alias("removed"),
        total(n, lambda m: fails(m) & gone(m)).alias("redundant"),
        total(n, lambda m: m["mask"] == own).alias("unique_fails"),
        total(lambda m: m["good"], removed).alias("good_lost"),
        total(lambda m: m["toxic"], removed).alias("toxic_lost"),
        total(share, fails).alias("shapley"),
    )


def audit_filters(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """How the five filters work on each other, for every part of ``docs`` and order of the filters.

    ``labels`` has ``doc_id, quality, toxic``. Without documents there are no rows.
    See ``document_masks`` for the filters, nulls, ties and repeated rows, and
    ``interactions`` for the columns.
    """
    return interactions(mask_counts(document_masks(docs, doc_id, text, part), labels))
