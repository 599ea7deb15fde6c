"""Skew-proof shapes give the same rows as the plain definition."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.operators import curation
from tracemill.operators.scale import (
    LAST,
    MAX,
    SUM,
    XOR,
    first_per_key,
    global_rank,
    heavy_keys,
    kth_smallest,
    salted_join,
    skewed_join,
    take_by_hash,
    take_first,
    with_group_values,
    with_previous,
    with_running,
)


def rows_with_a_hot_key(spark):
    rows = [("hot", i, i * i) for i in range(300)] + [(f"k{j}", i, i + j) for j in range(30) for i in range(j)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "key string, pos long, value long").repartition(5)


def test_previous_rows_across_blocks(spark):
    df = rows_with_a_hot_key(spark)
    wanted = {"one": (F.col("value"), 1), "two": (F.col("value"), 2)}
    plain = Window.partitionBy("key").orderBy("pos")
    expected = df.select("*", F.lag("value", 1).over(plain).alias("one"), F.lag("value", 2).over(plain).alias("two"))
    for block in (2, 7, 1024):
        got = with_previous(df, ["key"], "pos", wanted, block)
        assert sorted(got.collect(), key=repr) == sorted(expected.collect(), key=repr)


def test_running_values_across_blocks(spark):
    df = rows_with_a_hot_key(spark)
    # Gaps in the index, and values that are missing for longer than a block.
    df = df.where(F.pmod("pos", F.lit(5)) != 3).withColumn("seen", F.when(F.pmod("pos", F.lit(40)) == 4, F.col("value")))
    wanted = {
        "total": (SUM, F.col("value")),
        "mixed": (XOR, F.col("value")),
        "most": (MAX, -F.col("value")),
        "latest": (LAST, F.col("seen")),
        "seen_total": (SUM, F.col("seen")),
    }
    plain = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    expected = df.select(
        "*",
        F.sum("value").over(plain).alias("total"),
        F.bit_xor("value").over(plain).alias("mixed"),
        F.max(-F.col("value")).over(plain).alias("most"),
        F.last("seen", ignorenulls=True).over(plain).alias("latest"),
        F.sum("seen").over(plain).alias("seen_total"),
    )
    for block in (1, 7, 1024):
        got = with_running(df, ["key"], "pos", wanted, block)
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert with_running(df.limit(0), ["key"], "pos", wanted).count() == 0


def test_group_values_reach_every_block(spark):
    df = rows_with_a_hot_key(spark)
    groups = df.groupBy("key").agg(F.sum("value").alias("total"), F.max("pos").alias("last"))
    expected = df.join(groups.drop("last"), "key")
    got = with_group_values(df, groups, ["key"], "pos", "last", block=16)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.select(got.columns).collect()))


def test_salted_join(spark):
    df = rows_with_a_hot_key(spark)
    lookup = df.select("key").distinct().where("key <> 'k3'").withColumn("name", F.upper("key"))
    for how in ("inner", "left"):
        got = salted_join(df, lookup, ["key"], ["pos"], how, salts=8)
        expected = df.join(lookup, "key", how).select(got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_kept_table_is_smaller_than_a_checkpoint(spark):
    import os

    from tracemill.operators.scale import kept_table

    df = spark.range(100_000, numPartitions=2).withColumn("name", F.concat(F.lit("some token "), F.col("id") % 100))
    kept = kept_table(df)
    files = [path.removeprefix("file:") for path in kept.inputFiles()]
    assert sum(os.path.getsize(path) for path in files) < 16 * df.count()
    assert kept.count() == 100_000 and not kept.exceptAll(df).count()


def test_global_rank(spark):
    df = rows_with_a_hot_key(spark)
    ranked = global_rank(df, [F.desc("value"), F.asc("key"), F.asc("pos")], "rank").collect()
    ordered = sorted(df.collect(), key=lambda r: (-r.value, r.key, r.pos))
    assert {(r.key, r.pos): r.rank for r in ranked} == {(r.key, r.pos): i + 1 for i, r in enumerate(ordered)}


def test_first_row_wins_and_null_keys_are_equal(spark):
    df = spark.createDataFrame(
        [(3, None, "a"), (1, None, "a"), (2, 5, "a"), (0, 5, "b"), (4, 5, "a")], "ordinal int, contestId int, index string"
    )
    once = curation.deduplicate_problems(df)
    assert sorted(r.ordinal for r in once.collect()) == [0, 1, 2]
    assert sorted(first_per_key(once, ["contestId", "index"], "ordinal").collect()) == sorted(once.collect())


def test_exact_quota(spark):
    df = spark.range(1000).withColumnRenamed("id", "key")
    for quota in (0, 1, 7, 500, 1000, 5000):
        inside = take_by_hash(df, ["key"], 11, F.lit(quota))
        outside = take_by_hash(df, ["key"], 11, F.lit(quota), keep=False)
        assert inside.count() == min(quota, 1000)
        assert outside.count() == 1000 - min(quota, 1000)
        assert inside.intersect(outside).count() == 0
    first = {r.key for r in take_by_hash(df, ["key"], 11, F.lit(50)).collect()}
    assert first == {r.key for r in take_by_hash(df, ["key"], 11, F.lit(50)).collect()}
    assert first != {r.key for r in take_by_hash(df, ["key"], 12, F.lit(50)).collect()}


def test_splits(spark):
    df = spark.range(997).withColumnRenamed("id", "key")
    exact = curation.split_exactly(df, ["key"], 5).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in exact} == {"test": 200, "train": 797}
    hashed = curation.split_by_hash(df, ["key"], 5)
    assert hashed.count() == 997 and 120 < hashed.where("split = 'test'").count() < 280
    assert curation.shuffle_and_take(df, ["key"], 1, 0).count() == 997


def test_head_of_splits(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"))
    taken = curation.head_of_splits(df, "id", 10)
    assert sorted(r.id for r in taken.where("split = 'test'").collect()) == [0, 4]
    assert taken.where("split = 'train'").count() == 10
    assert curation.head_of_splits(df, "id", 0).count() == 100


def test_only_hot_keys_are_spread(spark):
    hot = spark.range(6000).select(F.lit("hot").alias("key"), F.lit(None).cast("long").alias("part"), F.col("id").alias("row"))
    even = spark.range(6000).select(F.format_string("k%d", F.col("id") % 3000).alias("key"), (F.col("id") % 2).alias("part"), F.col("id").alias("row"))
    rows = hot.union(even)
    lookup = rows.select("key", "part").distinct().where("key <> 'k3'").withColumn("name", F.upper("key"))
    found = heavy_keys(rows, ["key", "part"])
    named = rows.select("key", "part").distinct().where(F.array_contains(found, F.xxhash64("key", "part")))
    assert [r.key for r in named.collect()] == ["hot"]
    for how in ("inner", "left"):
        got = skewed_join(rows, lookup, ["key", "part"], found, ["row"], how, salts=8)
        expected = rows.join(lookup, ["key", "part"], how)
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.select(got.columns).collect()))
    assert skewed_join(rows.limit(0), lookup, ["key", "part"], heavy_keys(rows.limit(0), ["key"]), ["row"]).count() == 0


def test_a_hot_key_is_spread_over_tasks(spark):
    """A third of the rows under one key: no task of the join has twice the rows of the median one."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 997).alias("key"), F.col("id").alias("row")
    )
    lookup = spark.range(-1, 997).select(F.col("id").alias("key"), F.lit("x").alias("name"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        joined = skewed_join(rows, lookup, ["key"], heavy_keys(rows, ["key"]), ["row"], salts=64)
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(sizes) == 30_000 and len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]


def test_kth_smallest(spark):
    df = spark.range(500).select(
        F.format_string("%03d", F.col("id") % 100).alias("name"), (F.col("id") / 100).cast("int").alias("part")
    ).repartition(6)
    ordered = sorted(tuple(r) for r in df.collect())
    for count in (1, 2, 137, 499, 500):
        value = spark.range(1).select(kth_smallest(df, ["name", "part"], F.lit(count)).alias("v")).first().v
        assert tuple(value) == ordered[count - 1]
        assert sorted(tuple(r) for r in take_first(df, ["name", "part"], count).collect()) == ordered[:count]
    # Ties with the last stay; more than there are takes all; none takes none.
    assert take_first(df, ["name"], 7).count() == 10
    assert take_first(df, ["name"], 9_999).count() == 500
    assert take_first(df, ["name"], 0).count() == 0
    assert take_first(df.limit(0), ["name"], 3).count() == 0
    wanted = take_first(df, ["part"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in wanted.split("Subquery")[0]


def test_first_rows_of_values_with_nulls(spark):
    df = spark.createDataFrame([(None, 1), (2.5, 2), (float("nan"), 3), (-1.0, 4)], "x double, row int")
    assert sorted(r.row for r in take_first(df, ["x"], 2).collect()) == [1, 4]
    assert sorted(r.row for r in take_first(df, ["x"], 3).collect()) == [1, 2, 4]
