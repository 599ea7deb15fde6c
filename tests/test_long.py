"""Long conversations are one run and one chat, whatever their length."""

from pyspark.sql import functions as F

from tracemill.operators import curation
from tracemill.functions.tokens import strict_likelihood_cut
from tracemill.plans import views


def test_two_hundred_turns(spark, tmp_path):
    turns = spark.range(200).select(
        F.lit(3).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.lit("user").alias("role"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"),
    )
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    rows = views.trajectories(spark, str(tmp_path)).orderBy("step").collect()
    assert [r["step"] for r in rows] == list(range(200)) and {r["run_id"] for r in rows} == {0}
    pieces = [f"t{i}" if i % 3 == 0 else f"t{i - 1}" if i % 3 == 2 else "" for i in range(200)]
    assert rows[-1]["code"] == "".join(pieces)
    assert views.infos(spark, str(tmp_path)).agg(F.max("step")).first()[0] == 197
    chats = views.chats(spark, str(tmp_path)).collect()
    assert len(chats) == 1 and len(chats[0]["messages"]) == 200


def test_other_splits_stay(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["train", "test", "valid", None] * 5)], "id int, split string")
    kept = curation.head_of_splits(df, "id", 2).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in kept} == {"train": 2, "valid": 5, None: 5} | (
        {"test": int(2 * 0.1)} if int(2 * 0.1) else {}
    )


def test_threshold_zero_keeps_all(evaluate):
    cut = strict_likelihood_cut(F.array(*map(F.lit, (1, 2, 3))), F.array(*[F.lit(-500.0)] * 3), 0.0, 9)
    assert evaluate(cut) == [1, 2, 3]
