"""Shapes that keep ordered and skewed work spread over many tasks.

An episode, document or problem may hold a large share of all rows, so nothing
here sorts or collects one key's rows in one task: ordered work is done per
block of consecutive positions, ranks come from a range partitioning, and
lookups against a hot key go to salted copies.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.arrays import whole_div
from tracemill.functions.tokens import seeded_hash
from tracemill.session import use_shared_checkpoints

BLOCK = 1024
SALTS = 32
HASH_PREFIX = 4
#: A key with this share of the rows is spread over several tasks.
HOT_SHARE = 1 / 500


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Put all cores on an input of few splits, such as a file of one row group.

    An input with a split per core or more is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def block_of(index: str, block: int) -> Column:
    return whole_div(F.col(index), block)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    wanted: Mapping[str, tuple[Column, int]],
    block: int = BLOCK,
) -> DataFrame:
    """Add values of earlier rows of the same key: ``name -> (expression, rows back)``.

    The window is partitioned by key and block of ``index``. The last rows of a
    block are repeated in the next one, so a look-back never leaves its block.
    ``index`` counts rows from 0 without gaps.
    """
    reach = max(back for _, back in wanted.values())
    home = block_of(index, block)
    near_end = F.pmod(F.col(index), F.lit(block)) >= block - reach
    spread = df.withColumn(
        "_block", F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    window = Window.partitionBy(*keys, "_block").orderBy(index)
    added = [F.lag(value, back).over(window).alias(name) for name, (value, back) in wanted.items()]
    return spread.select("*", *added).where(F.col("_block") == home).drop("_block")


class Running(NamedTuple):
    """A running aggregate that can be taken block by block."""

    #: Over the rows of a block up to a row, and over the blocks before one.
    over: Callable[[Column], Column]
    #: Of a whole block, from values and their index.
    whole: Callable[[Column, Column], Column]
    #: Of what came before a block and what the block has so far.
    join: Callable[[Column, Column], Column]


def _either(combine: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda before, own: F.coalesce(combine(before, own), before, own)


SUM = Running(F.sum, lambda value, index: F.sum(value), _either(lambda before, own: before + own))
XOR = Running(F.bit_xor, lambda value, index: F.bit_xor(value), _either(lambda before, own: before.bitwiseXOR(own)))
MAX = Running(F.max, lambda value, index: F.max(value), _either(F.greatest))
#: The last value that is not null.
LAST = Running(
    lambda value: F.last(value, ignorenulls=True),
    lambda value, index: F.max_by(value, F.when(value.isNotNull(), index)),
    lambda before, own: F.coalesce(own, before),
)


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    wanted: Mapping[str, tuple[Running, Column]],
    block: int = BLOCK,
) -> DataFrame:
    """Add aggregates over all rows of a key up to and including each row: ``name -> (kind, expression)``.

    The reach is unbounded, yet no task sorts a whole hot key: rows are put in
    order per key and block of ``index``, and what came before a block is the
    running aggregate of one value per block. ``index`` is a whole number from
    0, unique within its key; gaps are allowed. Null values are passed over, and
    keys are not null.
    """
    rows = df.withColumn("_block", block_of(index, block))
    upto = Window.partitionBy(*keys, "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_block").agg(
        *[kind.whole(value, F.col(index)).alias(f"_of_{name}") for name, (kind, value) in wanted.items()]
    )
    earlier = totals.select(
        *keys,
        "_block",
        *[kind.over(F.col(f"_of_{name}")).over(before).alias(f"_to_{name}") for name, (kind, _) in wanted.items()],
    ).where("_block > 0")
    running = rows.select(
        "*", *[kind.over(value).over(upto).alias(f"_in_{name}") for name, (kind, value) in wanted.items()]
    )
    joined = running.join(earlier, [*keys, "_block"], "left")
    added = [kind.join(F.col(f"_to_{name}"), F.col(f"_in_{name}")).alias(name) for name, (kind, _) in wanted.items()]
    return joined.select(*df.columns, *added)


def with_group_values(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    index: str,
    last: str,
    block: int = BLOCK,
    how: str = "inner",
) -> DataFrame:
    """Join one row per key back to that key's many rows.

    Each group row is repeated once per block of ``index`` up to ``last``, so a
    hot key is looked up in as many places as it has blocks.
    """
    spread = groups.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), block_of(last, block)))
    ).drop(last)
    return rows.withColumn("_block", block_of(index, block)).join(spread, [*keys, "_block"], how).drop("_block")


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_on: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join rows to a much smaller lookup whose keys may be hot in ``rows``.

    The lookup has no size bound, so its copies are never broadcast.
    """
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    salted = rows.withColumn("_salt", F.pmod(F.hash(*spread_on), F.lit(salts)))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> Column:
    """The hashes of all keys that hold at least ``share`` of the rows, as an array to compare with.

    Found by a frequent-items sketch of bounded size, merged from all tasks: it
    may name a key that is a little rarer, but misses none that is as frequent.
    """
    most = int(1 / share)
    keyed = df.select(F.xxhash64(*keys).alias("key"))
    # The sketch's counts may be short by this part of the share; entries near it are named to be safe.
    tracked = 8 * most
    found = keyed.agg(
        F.expr(f"approx_top_k(key, {2 * most}, {tracked})").alias("top"), F.count("*").alias("rows")
    )
    heavy = F.transform(F.filter("top", lambda x: x["count"] >= F.col("rows") * share / 2), lambda x: x["item"])
    return found.select(F.coalesce(heavy, F.array().cast("array<bigint>"))).scalar()


def skewed_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    hot: Column,
    spread_on: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join rows to a lookup, spreading only the keys found to be hot (``heavy_keys``).

    All other keys join plainly and are copied nowhere. The copies of a hot key
    are one lookup row each; whether the lookup is broadcast is left to the size
    Spark measures as it runs.
    """
    is_hot = F.array_contains(hot, F.xxhash64(*keys))
    salt = F.when(is_hot, F.pmod(F.hash(*spread_on), F.lit(salts))).otherwise(0)
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = lookup.withColumn("_salt", F.explode(copies))
    return rows.withColumn("_salt", salt).join(copied, [*keys, "_salt"], how).drop("_salt")


def kth_smallest(df: DataFrame, order: Sequence[str], count: Column) -> Column:
    """The ``count``-th smallest value of ``order``, as a struct to compare with; null if there are fewer rows.

    ``order`` is any orderable columns. Their values are counted by range, which
    shows the one range that holds the value, and only that range is put in order.
    ``count`` may use ``total``, the number of rows.
    """
    use_shared_checkpoints(df.sparkSession)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(*[F.col(name).alias(f"v{i}") for i, name in enumerate(order)])
    values = df.select(place.alias("place")).groupBy("place").agg(F.count("*").alias("rows"))
    # The ranges are kept, so that counting and ordering speak of the same ones.
    dealt = values.repartitionByRange(partitions, "place").withColumn("part", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("part").agg(F.sum("rows").alias("size"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = (
        sizes.select("part", "size", F.sum("size").over(running).alias("upto"), F.sum("size").over(whole).alias("total"))
        .withColumn("wanted", count.cast("long"))
        .where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("size") < F.col("wanted")))
        .select("part", (F.col("wanted") - F.col("upto") + F.col("size")).alias("rest"))
    )
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        dealt.join(F.broadcast(edge), "part")
        .select("place", "rest", "rows", F.sum("rows").over(within).alias("upto"))
        .where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("rows") < F.col("rest")))
    )
    return found.select("place").scalar()


def take_first(df: DataFrame, order: Sequence[str], count: int) -> DataFrame:
    """The first ``count`` rows in ``order``; rows that tie with the last of them stay too.

    Rows are compared with one value where they are: none is shuffled, and no
    task holds all that are taken.
    """
    if count <= 0:
        return df.limit(0)
    # Fewer rows than asked for: the last of all is the edge.
    edge = kth_smallest(df, order, F.least(F.lit(count), F.col("total")))
    place = F.struct(*[F.col(name).alias(f"v{i}") for i, name in enumerate(order)])
    return df.where(place <= edge)


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keep the row with the lowest ``order`` (unique) for each key; NULL keys are equal.

    Only keys and ``order`` are aggregated, with partial results per task; wide
    columns are read once more and met by a semi join on the unique column.
    """
    winners = df.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
    return df.join(winners, order, "left_semi")


def kept_table(df: DataFrame) -> DataFrame:
    """Write a frame beside the checkpoints as compressed columns and read it back: lineage ends here.

    A checkpoint's files hold the rows as they are in memory, several times as
    large. The table is removed when the session's JVM ends.
    """
    spark = df.sparkSession
    use_shared_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number all rows from 1 in ``order``, without a single-task window.

    Rows are range partitioned and sorted, which fixes each row's place within
    its partition; adding the sizes of earlier partitions gives its rank. The
    placed rows are kept as a table so that sizes and rows come from one layout.
    """
    use_shared_checkpoints(df.sparkSession)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    placed = kept_table(placed)
    # One row per partition of the layout above: bounded by the setting.
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_place") + 1)
        .drop("_part", "_place", "_before")
    )


def hash_quota(df: DataFrame, keys: Sequence[str], seed: int, quota: Column) -> DataFrame:
    """One row holding the hash up to which exactly ``quota`` rows fall.

    ``quota`` may use ``total``, the row count. Keys must be unique. Hashes are
    counted by prefix (65,536 rows at most), and only the hashes of the one
    prefix in which the quota is reached are put in order.
    """
    hashed = df.select(seeded_hash(seed, *[F.col(key) for key in keys]).alias("_hash")).withColumn(
        "_prefix", F.substring("_hash", 1, HASH_PREFIX)
    )
    counts = hashed.groupBy("_prefix").agg(F.count("*").alias("_rows"))
    running = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = (
        counts.select(
            "_prefix",
            "_rows",
            F.sum("_rows").over(running).alias("_upto"),
            F.sum("_rows").over(whole).alias("total"),
        )
        .withColumn("_quota", F.least(quota.cast("long"), F.col("total")))
        .where((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_rows") < F.col("_quota")))
        .select("_prefix", (F.col("_quota") - F.col("_upto") + F.col("_rows")).alias("_rest"))
    )
    ordered = Window.partitionBy("_prefix").orderBy("_hash")
    return (
        hashed.join(F.broadcast(edge), "_prefix")
        .withColumn("_rank", F.row_number().over(ordered))
        .where(F.col("_rank") == F.col("_rest"))
        .select(F.col("_hash").alias("_last_hash"))
    )


def take_by_hash(df: DataFrame, keys: Sequence[str], seed: int, quota: Column, keep: bool = True) -> DataFrame:
    """Exactly ``quota`` rows in hash order, or with ``keep=False`` the others.

    The rows themselves are filtered in place and never shuffled.
    """
    last = hash_quota(df, keys, seed, quota).scalar()
    mine = seeded_hash(seed, *[F.col(key) for key in keys])
    inside = F.coalesce(mine <= last, F.lit(False))
    return df.where(inside if keep else ~inside)
