"""The vocabulary looked up inside the row: read and indexed once per worker, not per batch."""

from pyspark.sql import functions as F

from tracemill.operators.vocabulary import Lookup


def vocabulary(spark):
    return spark.createDataFrame([("a", 1), ("b", 2), (" ", 3), ("cc", 4)], "token string, token_id int")


def test_opened_once_per_worker(spark):
    lookup = Lookup(vocabulary(spark))
    # Every batch asks again; the table and its hash index come back built.
    assert lookup._open() is lookup._open()


def test_a_worker_keeps_few_vocabularies(spark):
    from tracemill.operators import vocabulary as module

    lookups = [Lookup(vocabulary(spark)) for _ in range(module.OPENED + 3)]
    opened = [lookup._open() for lookup in lookups]
    assert len(module._opened) <= module.OPENED and lookups[-1]._open() is opened[-1]


def test_ids_and_text_over_many_batches(spark):
    lookup = Lookup(vocabulary(spark))
    rows = [(1, ["a", " ", "b"]), (2, ["cc", "zz", None]), (3, []), (4, None), (5, ["b", "b", "a"])]
    frame = spark.createDataFrame(rows, "doc_id int, tokens array<string>").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = frame.select("doc_id", lookup.ids(F.col("tokens")).alias("ids")).withColumn(
            "text", lookup.text(F.array_append("ids", F.lit(99)))
        )
        found = {row["doc_id"]: (row["ids"], row["text"]) for row in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {
        1: ([1, 3, 2], "a b"),
        2: ([4, None, None], "cc"),
        3: ([], ""),
        4: ([], ""),
        5: ([2, 2, 1], "bba"),
    }
