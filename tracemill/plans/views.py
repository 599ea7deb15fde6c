"""The engine's input tables, derived from the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill import fixed_values as fixed
from tracemill.functions.arrays import drop, head, whole_div
from tracemill.functions.tokens import detokenize, offset_spans, tokenize
from tracemill.operators import curation
from tracemill.operators.scale import spread
from tracemill.operators.vocabulary import build_vocabulary, encode

CONTEST_DATE = "2024-01-01 00:00:00"
EOS_ID = 0
PAD_ID = 0
FENCE_IDS = [-1]
SEED = 7


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------------- problems

def raw_problems(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf, "documents").select(
        doc.alias("ordinal"),
        F.pmod(doc, F.lit(40)).alias("contestId"),
        F.col("lang").alias("index"),
        F.col("source").alias("name"),
        F.when(F.pmod(doc, F.lit(17)) != 0, F.col("n_chars")).alias("rating"),
        F.col("text").alias("problem-description"),
        F.col("lang").alias("input-specification"),
        F.col("source").alias("output-specification"),
        F.when(F.pmod(doc, F.lit(5)) != 0, "train").otherwise("test").alias("split"),
    )


def problems(spark: SparkSession, sf: str) -> DataFrame:
    formatted = (
        raw_problems(spark, sf)
        .transform(curation.deduplicate_problems)
        .transform(curation.format_problems, CONTEST_DATE)
    )
    odd = F.pmod("contest_id", F.lit(2)) == 1
    return formatted.withColumn("starter_code", F.when(odd, "def solve():").otherwise("")).transform(
        curation.conform_problems
    )


# ------------------------------------------------------------------- episodes

def trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as states: code grows by what was typed or accepted."""
    turns = table(spark, sf, "conversations").select(
        F.lit(0).cast("long").alias("run_id"),
        F.lit(0).alias("future"),
        F.col("conv_id").alias("episode_id"),
        F.col("turn").alias("step"),
        "text",
    )
    order = Window.partitionBy("run_id", "episode_id").orderBy("step")
    phase, kind = F.pmod("step", F.lit(3)), F.pmod("episode_id", F.lit(3))
    retyped = F.when((kind == 1) & (F.col("step") > 0), F.coalesce(F.lag("text", 2).over(order), F.lit("")))
    accepted = F.when(kind == 0, F.coalesce(F.lag("text", 1).over(order), F.lit("")))
    piece = (
        F.when(phase == 0, F.concat(F.coalesce(retyped, F.lit("")), "text"))
        .when(phase == 2, F.coalesce(accepted, F.lit("")))
        .otherwise("")
    )
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        turns.withColumn("_piece", piece)
        .withColumn("code", F.array_join(F.collect_list("_piece").over(so_far), ""))
        .select(
            "run_id",
            "future",
            "episode_id",
            "step",
            F.pmod("episode_id", F.lit(40)).cast("string").alias("contest_id"),
            F.element_at(
                F.array(*[F.lit(lang) for lang in ("de", "en", "es", "fr")]),
                (F.pmod(whole_div(F.col("episode_id"), 40), F.lit(4)) + 1).cast("int"),
            ).alias("question_id"),
            "code",
            F.when(phase == 1, F.concat("code", "text")).alias("suggested_completion"),
        )
    )


def forked_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """Three neighbouring episodes read as three futures of one."""
    return trajectories(spark, sf).select(
        "run_id",
        F.pmod("episode_id", F.lit(3)).cast("int").alias("future"),
        whole_div(F.col("episode_id"), 3).alias("episode_id"),
        "step",
        "code",
        "suggested_completion",
    )


#: Episodes of a run in the views of runs.
RUN_EPISODES = 10


def run_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """The forked trajectories, dealt out to runs of ten episodes."""
    forked = forked_trajectories(spark, sf)
    return forked.withColumn("run_id", whole_div(F.col("episode_id"), RUN_EPISODES))


def run_grades(spark: SparkSession, sf: str) -> DataFrame:
    """``run_id, grades``: per run one list per future of its episodes' grades, in order of the episodes.

    An episode without a label is half right.
    """
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id"), "quality")
    episode = whole_div(F.col("conv_id"), 3)
    graded = (
        table(spark, sf, "conversations")
        .select("conv_id")
        .distinct()
        .join(marks, "conv_id", "left")
        .select(
            whole_div(episode, RUN_EPISODES).alias("run_id"),
            F.pmod("conv_id", F.lit(3)).cast("int").alias("future"),
            episode.alias("episode_id"),
            F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("grade"),
        )
    )
    lists = graded.groupBy("run_id", "future").agg(
        F.sort_array(F.collect_list(F.struct("episode_id", "grade"))).alias("_list")
    )
    return (
        lists.select("run_id", F.struct("future", F.col("_list.grade").alias("grades")).alias("_future"))
        .groupBy("run_id")
        .agg(F.sort_array(F.collect_list("_future")).alias("_futures"))
        .select("run_id", F.col("_futures.grades").alias("grades"))
    )


def graded_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, payload``: labels as a grader's JSON records.

    Of every eleven one breaks off, one has errors that break off, and one is missing.
    """
    doc, kind = F.col("doc_id"), F.pmod("doc_id", F.lit(11))
    tests = F.transform(
        F.sequence(F.lit(0).cast("long"), F.pmod(doc, F.lit(4))), lambda i: F.pmod(i, F.lit(2)) <= F.col("quality")
    )
    errors = F.to_json(
        F.struct(
            F.when(F.col("toxic") == 1, -1).otherwise(-2).alias("error_code"),
            F.when(F.col("toxic") == 1, "Time Limit").otherwise('Wrong "Answer"').alias("error_message"),
        )
    )
    whole = F.to_json(
        F.struct(
            doc.alias("episode_id"),
            F.array(F.concat(F.lit("print("), doc.cast("string"), F.lit(")\n"))).alias("code_list"),
            tests.alias("graded_list"),
            F.col("quality").cast("double").alias("pass@1"),
            F.when(kind == 5, "{broken").when(F.col("quality") == 0, errors).alias("errors"),
        )
    )
    cut = F.substring(whole, F.lit(1), F.length(whole) - 4)
    return table(spark, sf, "labels").select(
        "doc_id", F.when(kind == 3, cut).when(kind != 7, whole).alias("payload")
    )


def dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as rows that episodes were rolled out on, with an old code to be replaced."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("episode_id"), "lang", "n_chars", F.lit("old").alias("code")
    )


def infos(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.pmod("conv_id", F.lit(3))
    prob = F.lit(1.0) / (F.length("text") + 1)
    action = F.when(kind == 0, "accept").when(kind == 1, "reject").otherwise("finish")
    step = F.col("turn")
    return (
        table(spark, sf, "conversations")
        .where(F.pmod(step, F.lit(3)) == 2)
        .select(
            F.lit(0).cast("long").alias("run_id"),
            F.lit(0).alias("future"),
            F.col("conv_id").alias("episode_id"),
            step.alias("step"),
            F.col("text").alias("reasoning"),
            prob.alias("accept_prob"),
            action.alias("action"),
            F.ln(prob).alias("logprob"),
        )
    )


def results(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("episode_id"), F.col("quality").cast("double").alias("pass@1")
    )


# --------------------------------------------------------------------- tokens

_vocabularies: dict[tuple[str, str], DataFrame] = {}


def words(spark: SparkSession, sf: str) -> DataFrame:
    texts = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return texts.select("doc_id", tokenize(F.col("text")).alias("tokens"))


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """The vocabulary table, built once per session from the whole corpus."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _vocabularies:
        tokens = words(spark, sf).select(F.explode("tokens").alias("token"))
        _vocabularies[key] = build_vocabulary(tokens)
    return _vocabularies[key]


def token_ids(spark: SparkSession, sf: str, keep_tokens: bool = False) -> DataFrame:
    """(doc_id, ids, state_ids): whole documents, the state being their first third."""
    coded = encode(words(spark, sf), ["doc_id"], "tokens", vocabulary(spark, sf), keep_tokens, own_texts=True)
    third = whole_div(F.size("ids"), 3).cast("int")
    return coded.withColumn("state_ids", head(F.col("ids"), third))


def token_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Completion tokens past the state, each with a probability from its length and place."""
    third = F.size("state_ids")
    return token_ids(spark, sf, keep_tokens=True).select(
        "doc_id",
        "ids",
        "state_ids",
        drop(F.col("ids"), third).alias("completion_ids"),
        F.transform(
            drop(F.col("tokens"), third),
            lambda token, pos: F.lit(1.0) - F.lit(1.0) / (F.length(token) * 8 + pos + 2),
        ).alias("probs"),
    )


def logits(spark: SparkSession, sf: str) -> DataFrame:
    vec = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        whole_div(vec, 10).alias("example_id"),
        F.pmod(vec, F.lit(10)).alias("pos"),
        F.col("label").alias("token_id"),
        F.col("embedding").alias("logits"),
    )


def futures(spark: SparkSession, sf: str) -> DataFrame:
    """Two futures over a horizon of 32: a code of 64 ids and one that leaves it at one place.

    States hold 8 to 17 ids, padded to 24 with the end token.
    """
    code = F.sequence(F.lit(1), F.lit(64))
    vector, held = F.col("embedding"), F.col("label") + 8
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("example_id"),
        F.when(F.pmod("vec_id", F.lit(5)) != 0, "train").otherwise("test").alias("split"),
        F.array(F.slice(vector, 1, 32), F.slice(vector, 33, 32)).alias("q"),
        F.concat(F.sequence(F.lit(1), held), F.array_repeat(F.lit(EOS_ID), 24 - held)).alias("state_ids"),
        code.alias("code_ids"),
        F.array(
            F.transform(code, lambda x, i: F.when(i == F.col("label") + 20, x + 1000).otherwise(x))
        ).alias("null_ids"),
    )


def decision_tokens(spark: SparkSession, sf: str) -> DataFrame:
    words_by_type = F.create_map(
        *[
            F.lit(part)
            for pair in (
                ("purchase", " Accept"),
                ("click", "accept"),
                ("view", "reject "),
                ("signup", "Finish"),
                ("error", "other"),
            )
            for part in pair
        ]
    )
    return table(spark, sf, "events").select(
        "user_id",
        F.col("ts").cast("date").cast("string").alias("day"),
        F.try_element_at(words_by_type, F.col("event_type")).alias("token_text"),
        (-F.col("value") / 50).alias("logprob"),
    )


def logprob_maps(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """``user_id, day, all_logprobs``, and the vocabulary of its ids: that of all documents and decision tokens.

    A token that came up several times has its best log probability.
    """
    tokens = decision_tokens(spark, sf).where(F.col("token_text").isNotNull())
    of_documents = words(spark, sf).select(F.explode("tokens").alias("token"))
    known = build_vocabulary(of_documents.union(tokens.select("token_text")))
    best = tokens.groupBy("user_id", "day", F.col("token_text").alias("token")).agg(F.max("logprob").alias("logprob"))
    ids = known.join(tokens.select(F.col("token_text").alias("token")).distinct(), "token").select("token", "token_id")
    entries = F.collect_list(F.struct("token_id", "logprob"))
    maps = best.join(ids, "token").groupBy("user_id", "day").agg(F.map_from_entries(entries).alias("all_logprobs"))
    return maps, known


def training_examples(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, lang, state, correct_completion``: a document's first eighth, and all of it with a closing fence."""
    texts = spread(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")
    eighth = whole_div(F.length("text"), 8).cast("int")
    return texts.select(
        "doc_id",
        "lang",
        F.substring("text", F.lit(1), eighth).alias("state"),
        F.concat("text", F.lit(fixed.FENCE)).alias("correct_completion"),
    )


def supervised_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt, state and completion (state included): two quarters, then all the rest."""
    ids = F.col("ids")
    quarter = whole_div(F.size(ids), 4).cast("int")
    return token_ids(spark, sf).select(
        "doc_id",
        head(ids, quarter).alias("prompt_ids"),
        head(drop(ids, quarter), quarter).alias("state_ids"),
        drop(ids, quarter).alias("completion_ids"),
    )


def offset_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens after two fences with their offsets, and the half of their text that is the state.

    The state prompt of every seventh row is its whole text and a closing marker.
    """
    fences = F.array(F.lit("```python\nseed```"), F.lit("```python\n"))
    text = F.col("_text")
    return (
        token_ids(spark, sf, keep_tokens=True)
        .withColumn("tokens", F.concat(fences, "tokens"))
        .withColumn("ids", F.concat(F.array(F.lit(-1), F.lit(-2)), "ids"))
        .withColumn("_text", detokenize(F.col("tokens")))
        .select(
            "doc_id",
            "tokens",
            "ids",
            offset_spans(F.col("tokens")).alias("spans"),
            F.when(F.pmod("doc_id", F.lit(7)) == 0, F.concat(text, F.lit(fixed.CHAT_END_OF_TURN)))
            .otherwise(F.substring(text, F.lit(1), whole_div(F.length(text), 2).cast("int")))
            .alias("state_prompt"),
        )
    )


# ----------------------------------------------------------------------- text

def snippets(spark: SparkSession, sf: str) -> DataFrame:
    kind, text = F.pmod("conv_id", F.lit(4)), F.col("text")
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.when(kind == 1, F.concat(F.lit("```python\n"), text, F.lit("```")))
        .when(kind == 2, F.concat(F.lit("```\n"), text))
        .when(kind == 3, F.concat(text, F.lit("```tail")))
        .otherwise(text)
        .alias("snippet"),
    )


def chats(spark: SparkSession, sf: str) -> DataFrame:
    """One chat per conversation."""
    return (
        table(spark, sf, "conversations")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns"))
        .select(
            "conv_id",
            F.transform(
                "_turns",
                lambda turn: F.struct(turn["role"].alias("role"), turn["text"].alias("content")),
            ).alias("messages"),
        )
    )
