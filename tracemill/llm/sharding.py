"""A uniform shuffle into shards of exact size.

The input's files are the partitions of the shuffle. How many of a partition's
rows go to each shard is drawn from the multivariate hypergeometric law, which
is the law of a uniform shuffle; within a partition and again within a shard
the places are permuted. Each task draws its own row of the communication
matrix by walking a tree of splits from the seed, so the matrix is never held
in one place and a repeated task draws the same row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import stage

ROUNDS = 8
#: Rows of a shard that are kept together in the exchange.
BLOCK_ROWS = 4096
#: Populations up to here are drawn by numpy's own sampler.
NUMPY_LIMIT = 900_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from a population are good; exact law at any size."""
    if good + bad <= NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    variance = draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))
    reach = int(40 * variance**0.5) + 40
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    chances = np.cumsum(np.exp(weights - weights.max()))
    return first + int(np.searchsorted(chances, rng.random() * chances[-1], side="right"))


def draw_split(rng: np.random.Generator, colours: np.ndarray, draws: int) -> np.ndarray:
    """Counts by colour among ``draws`` items taken from ``colours`` without replacement."""
    counts, left = np.zeros_like(colours), int(colours.sum())
    for i, here in enumerate(colours):
        left -= int(here)
        counts[i] = hypergeometric(rng, int(here), left, draws)
        draws -= int(counts[i])
    return counts


def matrix_row(starts: np.ndarray, shard_rows: np.ndarray, seed: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts sent by ``part`` to each shard, and what earlier parts send there.

    ``starts`` holds the rows before each part and, last, all rows.
    """
    low, high = 0, len(starts) - 1
    mine, before = shard_rows.astype(np.int64), np.zeros(len(shard_rows), np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = draw_split(rng, mine, int(starts[middle] - starts[low]))
        if part < middle:
            mine, high = left, middle
        else:
            mine, before, low = mine - left, before + left, middle
    return mine, before


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=256)
def _keys(seed: int, stream: int, number: int) -> tuple[np.uint64, ...]:
    return tuple(np.random.default_rng([seed, stream, number]).integers(1 << 63, size=ROUNDS, dtype=np.uint64))


def permute(places: np.ndarray, size: int, keys: tuple[np.uint64, ...]) -> np.ndarray:
    """A keyed permutation of ``0 .. size - 1``, applied to some places.

    A Feistel network over the next power of four; what falls outside walks on.
    Needs no memory beyond the places themselves.
    """
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = places.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (_mix(right ^ key) & mask)
        out[todo] = (left << half) | right
        todo = out >= np.uint64(size)
    return out.astype(np.int64)


def place_rows(df: DataFrame) -> tuple[DataFrame, list[tuple[str, int]]]:
    """The rows with their file and place in it, and the rows of each file.

    A frame that is not a plain scan of Parquet files is staged first.
    """

    def placed(source: DataFrame) -> DataFrame:
        meta = source.metadataColumn("_metadata")
        return source.select("*", meta["file_path"].alias("_file"), meta["row_index"].alias("_place"))

    def sizes(source: DataFrame) -> list:
        found = source.groupBy("_file").agg(F.count("*").alias("rows"), (F.max("_place") + 1).alias("span"))
        return sorted((r["_file"], r["rows"], r["span"]) for r in found.collect())  # one row per file

    try:
        rows = placed(df)
        found = sizes(rows)
        plain = all(count == span for _, count, span in found)
    except AnalysisException:
        plain = False
    if not plain:
        rows = placed(stage(df, "rows"))
        found = sizes(rows)
    return rows, [(name, count) for name, count, _ in found]


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """All rows with ``shard`` and ``slot``, exchanged and in slot order.

    Shard sizes differ by one row at most; slots count from 0 without gaps.
    Every arrangement of the rows over shards and slots is as likely as any
    other (up to the quality of the keyed permutations), whatever the rows
    hold: nulls, equal rows and hot keys need no care, as places, not values,
    decide. An empty frame gives no rows. Columns named ``shard`` or ``slot``
    are replaced. The same files, seed and shard count give the same shuffle.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows, files = place_rows(df.drop("shard", "slot"))
    total = sum(count for _, count in files)
    number = {name: i for i, (name, _) in enumerate(files)}
    starts = np.concatenate([[0], np.cumsum([count for _, count in files])]).astype(np.int64)
    shard_rows = np.array([total // shards + (i < total % shards) for i in range(shards)], np.int64)
    shared = df.sparkSession.sparkContext.broadcast((number, starts, shard_rows))

    @F.pandas_udf("struct<shard: int, slot: long>")
    def deal(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        number, starts, shard_rows = shared.value
        row_of = lru_cache(maxsize=64)(lambda part: matrix_row(starts, shard_rows, seed, part))
        for names, places in batches:
            shard = np.zeros(len(names), np.int32)
            slot = np.zeros(len(names), np.int64)
            places = places.to_numpy()
            codes, found = pd.factorize(names)
            for code, name in enumerate(found):
                here = np.flatnonzero(codes == code)
                part = number[name]
                counts, before = row_of(part)
                ends = np.cumsum(counts)
                local = permute(places[here], int(ends[-1]), _keys(seed, 1, part))
                to = np.searchsorted(ends, local, side="right")
                shard[here] = to
                slot[here] = local - (ends - counts)[to] + before[to]
            for to in np.unique(shard):
                here = np.flatnonzero(shard == to)
                slot[here] = permute(slot[here], int(shard_rows[to]), _keys(seed, 2, int(to)))
            yield pd.DataFrame({"shard": shard, "slot": slot})

    dealt = rows.withColumn("_to", deal("_file", "_place")).drop("_file", "_place")
    block = F.floor(F.col("_to.slot") / BLOCK_ROWS)
    return (
        dealt.repartition(F.col("_to.shard"), block)
        .select("*", "_to.shard", "_to.slot")
        .drop("_to")
        .sortWithinPartitions("shard", "slot")
    )
