"""Sketches of counts that prove items to occur once.

Every item has a few cells, one per hash function: anywhere in the sketch
(counting Bloom filter), or each in a row of its own (count-min sketch). A
cell's count is at least the number of times any of its items occurs, so an
item with a cell that was counted once occurs once. The converse does not hold:
what is not cleared has to be counted exactly.

Each task's cells are summed before they are merged by shuffle. Of the merged
counts only "one" or "more" matters for the proof, so one bit per cell is
gathered and broadcast: at most ``MAX_CELLS`` bits, 128 MiB. Beyond
``MAX_CELLS / CELLS_PER_ITEM`` items the sketch fills up and clears fewer of
them; results stay the same, as only the exact count decides.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS_PER_ITEM = 8
LEAST_CELLS, MAX_CELLS = 1 << 12, 1 << 30
#: Hash functions of a Bloom filter, and rows of a count-min sketch.
HASHES = 3
#: Cells whose bits travel in one row.
CHUNK_CELLS = 1 << 22


def width_for(items: int) -> int:
    """Cells for so many items: a power of two within the bounds."""
    return min(MAX_CELLS, max(LEAST_CELLS, 1 << (items * CELLS_PER_ITEM - 1).bit_length()))


def cells_of(digest: Sequence[Column], width: int, by_row: bool) -> list[Column]:
    """The cells of an item, one per hash function; ``by_row`` splits the width into a row for each."""
    own = width // HASHES if by_row else width
    return [
        F.pmod(F.xxhash64(F.lit(i), *digest), F.lit(own).cast("long")) + (i * own if by_row else 0) for i in range(HASHES)
    ]


def counts(items: DataFrame, cells: Sequence[Column]) -> DataFrame:
    """``cell, n``: the merged sketch of all items."""
    return items.select(F.explode(F.array(*cells)).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))


def repeated_bits(sketch: DataFrame, width: int) -> np.ndarray:
    """One bit per cell, as bytes: whether it was counted more than once."""
    chunk = min(width, CHUNK_CELLS)

    def pack(rows: pa.Table) -> pa.Table:
        bits = np.zeros(chunk, np.uint8)
        bits[rows.column("cell").to_numpy() % chunk] = 1
        return pa.table({"chunk": rows.column("chunk")[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    # At most MAX_CELLS / CHUNK_CELLS rows come to the driver, the bitmap and no more.
    more = sketch.where("n > 1").select("cell", F.call_function("div", F.col("cell"), F.lit(chunk)).alias("chunk"))
    out = np.zeros((-(-width // chunk), chunk // 8), np.uint8)
    for row in more.groupBy("chunk").applyInArrow(pack, "chunk long, bits binary").collect():
        out[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


class Screen:
    """Which items may occur more than once, asked row by row of narrow columns."""

    def __init__(self, items: DataFrame, digest: Sequence[str], by_row: bool = False) -> None:
        self.by_row = by_row
        self.width = width_for(items.count())
        bits = repeated_bits(counts(items, self._cells([F.col(name) for name in digest])), self.width)
        held = items.sparkSession.sparkContext.broadcast(bits.tobytes())

        def look_up(*cells: pd.Series) -> pd.Series:
            bitmap = np.frombuffer(held.value, np.uint8)
            found = np.ones(len(cells[0]), bool)
            for column in cells:
                places = column.to_numpy()
                found &= (bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            return pd.Series(found)

        def first(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return look_up(a, b, c)

        self._asked = F.pandas_udf(first, "boolean")

    def _cells(self, digest: Sequence[Column]) -> list[Column]:
        return cells_of(digest, self.width, self.by_row)

    def may_repeat(self, *digest: Column) -> Column:
        """Whether an item may occur more than once; ``False`` is certain."""
        return self._asked(*self._cells(digest))
