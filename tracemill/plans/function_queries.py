"""The caller's Python over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tracemill.operators import user_functions
from tracemill.plans import views
from tracemill.plans.registry import query


def shared_words(text: str, word: str, least: int) -> int:
    """How often ``word`` stands in ``text``, or ``least`` if that is more."""
    return max(least, text.split().count(word))


@query(
    "map_rows_u1",
    r"""SELECT doc_id, greatest(2, len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t = 'the'))) AS hits
        FROM documents""",
)
def map_rows(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    counted = user_functions.map_rows(docs.withColumn("word", F.lit("the")), shared_words, ["text", "word"], "hits", "long", least=2)
    return counted.select("doc_id", "hits")


def norms(frame: pd.DataFrame) -> pd.DataFrame:
    squares = frame["embedding"].map(lambda vector: float((vector.astype("float64") ** 2).sum()))
    return pd.DataFrame({"vec_id": frame["vec_id"], "squares": squares.round(4)})


@query(
    "map_batches_u2",
    """SELECT vec_id, round((SELECT sum(x::DOUBLE * x::DOUBLE) FROM (SELECT unnest(embedding) AS x)), 4) AS squares
       FROM embeddings""",
)
def map_batches(spark, sf):
    rows = views.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return user_functions.map_batches(rows, norms, "vec_id long, squares double", batch_rows=256)


@query(
    "filter_by_key_u3",
    "SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality = 1",
)
def filter_by_key(spark, sf):
    flags = views.table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("flag"))
    return user_functions.filter_by_key(views.table(spark, sf, "documents").select("doc_id", "source"), flags, ["doc_id"])


@query(
    "map_by_key_u3",
    "SELECT doc_id, source, quality AS passed FROM documents LEFT JOIN labels USING (doc_id)",
)
def map_by_key(spark, sf):
    values = views.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("passed"))
    return user_functions.map_by_key(views.table(spark, sf, "documents").select("doc_id", "source"), values, ["doc_id"])


def last_words(prompts: list[str]) -> list[str]:
    """Stand-in generator: answers each prompt with its last word."""
    return [prompt.split()[-1] for prompt in prompts]


@query(
    "generate_u4",
    r"""SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')[-1] AS answer
        FROM conversations""",
)
def generate(spark, sf):
    turns = views.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return user_functions.generate(turns, "text", "answer", last_words).drop("text")
