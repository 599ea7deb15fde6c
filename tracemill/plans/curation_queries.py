"""Problem curation, subsets and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import curation
from tracemill.operators.scale import take_by_hash
from tracemill.plans import views
from tracemill.plans.registry import query
from tracemill.plans.views import CONTEST_DATE, SEED

RAW_COLUMNS = 'ordinal, "contestId" AS contest, "index" AS letter, name, rating, split'


def raw_columns(df):
    return df.select(
        "ordinal", F.col("contestId").alias("contest"), F.col("index").alias("letter"), "name", "rating", "split"
    )


@query("read_split_s1", f"SELECT {RAW_COLUMNS} FROM v_raw WHERE split = 'train'")
def read_split(spark, sf):
    return raw_columns(views.raw_problems(spark, sf).where(F.col("split") == "train"))


@query("read_all_splits_s2", "SELECT split, count(*) AS n, count(rating) AS rated FROM v_raw GROUP BY split")
def read_all_splits(spark, sf):
    return views.raw_problems(spark, sf).groupBy("split").agg(
        F.count("*").alias("n"), F.count("rating").alias("rated")
    )


@query(
    "rename_columns_p1",
    'SELECT ordinal, name AS question_title, "index" AS question_id, "contestId" AS contest_id FROM v_raw',
)
def rename_columns(spark, sf):
    return curation.rename_raw(views.raw_problems(spark, sf)).select(
        "ordinal", "question_title", "question_id", "contest_id"
    )


@query(
    "add_constants_p2",
    f"""SELECT ordinal, 'codeforces' AS platform, '{CONTEST_DATE}' AS contest_date, '' AS starter_code,
               '[]' AS public_test_cases, '[]' AS private_test_cases, '[]' AS metadata FROM v_raw""",
)
def add_constants(spark, sf):
    return curation.add_constants(views.raw_problems(spark, sf), CONTEST_DATE).select(
        "ordinal", "platform", "contest_date", "starter_code", "public_test_cases", "private_test_cases", "metadata"
    )


@query(
    "difficulty_p3",
    """SELECT ordinal, rating, CASE WHEN rating < 1000 THEN 'easy' WHEN rating < 2000 THEN 'medium'
       ELSE 'hard' END AS difficulty FROM v_raw""",
)
def difficulty(spark, sf):
    return curation.add_difficulty(views.raw_problems(spark, sf)).select("ordinal", "rating", "difficulty")


@query(
    "question_content_p4",
    """SELECT ordinal, "problem-description" || "input-specification" || "output-specification" AS question_content
       FROM v_raw""",
)
def question_content(spark, sf):
    return curation.add_question_content(views.raw_problems(spark, sf)).select("ordinal", "question_content")


@query(
    "problem_columns_p5",
    """SELECT name AS question_title,
              "problem-description" || "input-specification" || "output-specification" AS question_content,
              'codeforces' AS platform, "index" AS question_id, "contestId" AS contest_id,
              '2024-01-01 00:00:00' AS contest_date, '' AS starter_code,
              CASE WHEN rating < 1000 THEN 'easy' WHEN rating < 2000 THEN 'medium' ELSE 'hard' END AS difficulty,
              '[]' AS public_test_cases, '[]' AS private_test_cases, '[]' AS metadata
       FROM v_raw""",
)
def problem_columns(spark, sf):
    return curation.format_problems(views.raw_problems(spark, sf), CONTEST_DATE)


@query("drop_if_present_p6", 'SELECT ordinal, "contestId" AS contest, split FROM v_raw')
def drop_if_present(spark, sf):
    kept = curation.drop_if_present(
        views.raw_problems(spark, sf).withColumn("completion", F.col("name")),
        ["completion", "input_ids_state", "problem-description", "input-specification",
         "output-specification", "index", "name", "rating"],
    )
    return kept.withColumnRenamed("contestId", "contest")


@query("drop_derived_p7", "SELECT doc_id, lang, source FROM documents")
def drop_derived(spark, sf):
    wide = views.table(spark, sf, "documents").select(
        "doc_id",
        "lang",
        "source",
        F.length("text").alias("input_ids_state"),
        F.col("n_chars").alias("attention_mask"),
        F.col("n_chars").alias("empowerment_q"),
        F.col("text").alias("labels"),
        F.col("text").alias("next_states"),
    )
    return curation.drop_derived(wide)


@query(
    "conform_problems_p8",
    """SELECT question_title, question_content, platform, question_id, contest_id, contest_date, starter_code,
              difficulty, '[]' AS public_test_cases, private_test_cases, '{}' AS metadata FROM v_problems""",
)
def conform_problems(spark, sf):
    return curation.conform_problems(views.problems(spark, sf).drop("public_test_cases", "metadata"))


@query(
    "head_of_splits_p9",
    f"""SELECT {RAW_COLUMNS} FROM v_raw
        QUALIFY row_number() OVER (PARTITION BY split ORDER BY ordinal) <= CASE split WHEN 'train' THEN 100 ELSE 20 END""",
)
def head_of_splits(spark, sf):
    return raw_columns(curation.head_of_splits(views.raw_problems(spark, sf), "ordinal", 100))


@query(
    "date_window_f5",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_day FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-06-01'""",
)
def date_window(spark, sf):
    return curation.from_date(views.table(spark, sf, "orders"), "o_orderdate", "1996-06-01 00:00:00").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_day")
    )


@query(
    "concatenate_splits_j1",
    """SELECT ordinal, split, name FROM v_raw WHERE split = 'train'
       UNION ALL SELECT ordinal, split, name FROM v_raw WHERE split = 'test'""",
)
def concatenate_splits(spark, sf):
    raw = views.raw_problems(spark, sf).select("ordinal", "name", "split")
    return curation.concatenate_splits(
        {name: raw.where(F.col("split") == name).drop("split") for name in ("train", "test")}
    ).select("ordinal", "split", "name")


@query("deduplicate_j2", f'SELECT {RAW_COLUMNS}, "problem-description" AS description FROM v_dedup')
def deduplicate(spark, sf):
    kept = curation.deduplicate_problems(views.raw_problems(spark, sf))
    return kept.select(
        "ordinal", F.col("contestId").alias("contest"), F.col("index").alias("letter"), "name", "rating", "split",
        F.col("problem-description").alias("description"),
    )


@query("sort_problems_o1", "SELECT question_id, contest_id, question_title FROM v_problems ORDER BY 1, 2")
def sort_problems(spark, sf):
    return curation.sort_problems(views.problems(spark, sf)).select("question_id", "contest_id", "question_title")


HASH = "md5(concat_ws('|', {key}, '{seed}'))"
DOC_HASH = HASH.format(key="doc_id::VARCHAR", seed=SEED)


@query("shuffle_and_take_o2", f"SELECT doc_id, source FROM documents ORDER BY {DOC_HASH} LIMIT 150")
def shuffle_and_take(spark, sf):
    return curation.shuffle_and_take(views.table(spark, sf, "documents").select("doc_id", "source"), ["doc_id"], SEED, 150)


@query(
    "split_by_hash_o3",
    f"""SELECT doc_id, CASE WHEN ('0x' || substr({DOC_HASH}, 1, 8))::BIGINT % 1000000 < 200000 THEN 'test'
        ELSE 'train' END AS split FROM documents""",
)
def split_by_hash(spark, sf):
    return curation.split_by_hash(views.table(spark, sf, "documents").select("doc_id"), ["doc_id"], SEED)


@query(
    "split_exactly_o3",
    f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {DOC_HASH})
        <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM documents""",
)
def split_exactly(spark, sf):
    return curation.split_exactly(views.table(spark, sf, "documents").select("doc_id"), ["doc_id"], SEED)


TEST_HASH = HASH.format(key="ordinal::VARCHAR", seed=SEED)


@query(
    "test_subset_o4",
    f"""SELECT ordinal, name FROM v_raw WHERE split = 'test'
        QUALIFY row_number() OVER (ORDER BY {TEST_HASH})
                <= (SELECT floor(0.2 * least(500, count(*))) FROM v_raw WHERE split = 'train')""",
)
def test_subset(spark, sf):
    raw = views.raw_problems(spark, sf).select("ordinal", "name", "split")
    train_rows = raw.where(F.col("split") == "train").agg(F.count("*")).scalar()
    test = raw.where(F.col("split") == "test").select("ordinal", "name")
    return take_by_hash(test, ["ordinal"], SEED, curation.test_quota(0.2, 500, train_rows))
