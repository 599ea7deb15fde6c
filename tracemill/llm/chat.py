"""Reply trees as conversations.

Doubling self-joins carry every message up to its root, which gives path scores
for ranking the branches, and then list the messages of the chosen branches.
Each chosen path is formatted as one conversation. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import stage

OPEN, HEAD, BODY_END, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
#: The first character of a control string, looking ahead at the rest of it.
CONTROL = r"([\[<])(?=/?(?:INST\]|s>))"
LEARNT_ROLE = "assistant"
NULL_KEY = "\x00null"


def escape(text: Column) -> Column:
    """Break control strings with a backslash after their first character; backslashes double."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(NULL_KEY))


def clean_messages(
    df: DataFrame, tree: str, node: str, parent: str, role: str, text: str, score: str | None
) -> DataFrame:
    """``_tree, _node, _parent, _role, _text, _score`` with one row per message.

    Null ids are ids like others; null roles and texts are empty, a null score
    is 0. Of rows that share an id the least (parent, role, text, score) stays.
    A parent that the tree does not hold makes the message a root.
    """
    rows = df.select(
        _key(tree).alias("_tree"),
        _key(node).alias("_node"),
        F.struct(
            F.col(parent).cast("string").alias("_parent"),
            F.coalesce(role, F.lit("")).alias("_role"),
            F.coalesce(text, F.lit("")).alias("_text"),
            (F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("_score"),
        ).alias("_row"),
    )
    return rows.groupBy("_tree", "_node").agg(F.min("_row").alias("_row")).select("_tree", "_node", "_row.*")


def climb(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jumps of 1, 2, 4, ... messages upward, and depth and path score of every message.

    Each round joins the jump table to itself, so a path of n messages takes
    log2(n) rounds and no round holds more than one row per message; messages
    that have reached their root are not joined again. Every round is staged. A
    cycle has no root; it is an error.
    """
    narrow = messages.select("_tree", "_node", "_parent", "_score")
    there = narrow.select("_tree", F.col("_node").alias("_parent"), F.col("_node").alias("_up"))
    table = stage(
        narrow.join(there, ["_tree", "_parent"], "left").select(
            "_tree", "_node", "_up", F.lit(1).cast("long").alias("_depth"), F.col("_score").alias("_total")
        ),
        "jump",
    )
    jumps = [table]
    count = None
    while table.where(F.col("_up").isNotNull()).limit(1).count():
        if count is None:
            count = table.count()
        if 1 << len(jumps) > 4 * count:
            raise ValueError("the parents of some messages form a cycle")
        above = table.select(
            "_tree",
            F.col("_node").alias("_up"),
            F.col("_up").alias("_next"),
            F.col("_depth").alias("_more"),
            F.col("_total").alias("_above"),
        )
        higher = table.where(F.col("_up").isNotNull()).join(above, ["_tree", "_up"]).select(
            "_tree",
            "_node",
            F.col("_next").alias("_up"),
            (F.col("_depth") + F.col("_more")).alias("_depth"),
            (F.col("_total") + F.col("_above")).alias("_total"),
        )
        table = stage(table.where(F.col("_up").isNull()).unionByName(higher), "jump")
        jumps.append(table)
    return jumps, table.drop("_up")


def best_paths(messages: DataFrame, branches: int | None) -> DataFrame:
    """``_tree, _leaf, _node, _depth``: the messages of every tree's best branches.

    A branch is a leaf with the messages above it; its score is their mean
    score. The best ``branches`` per tree are chosen (ties: the smaller leaf
    id), all with None.
    """
    jumps, depths = climb(messages)
    parents = jumps[0].where(F.col("_up").isNotNull()).select("_tree", F.col("_up").alias("_node")).distinct()
    leaves = depths.join(parents, ["_tree", "_node"], "left_anti")
    if branches is not None:
        order = Window.partitionBy("_tree").orderBy(F.desc(F.col("_total") / F.col("_depth")), "_node")
        leaves = leaves.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= branches)
    paths = leaves.select("_tree", F.col("_node").alias("_leaf"), "_node", "_depth")
    # Every distance above the leaf is a sum of distinct jumps, so each message is met once.
    for jump in reversed(jumps):
        step = jump.where(F.col("_up").isNotNull()).select("_tree", "_node", "_up")
        size = 1 << jumps.index(jump)
        higher = paths.join(step, ["_tree", "_node"]).select(
            "_tree", "_leaf", F.col("_up").alias("_node"), (F.col("_depth") - size).alias("_depth")
        )
        paths = stage(paths.unionByName(higher), "paths")
    return paths


def format_conversations(
    df: DataFrame,
    tree: str,
    node: str,
    parent: str,
    role: str = "role",
    text: str = "text",
    score: str | None = None,
    branches: int | None = 1,
) -> DataFrame:
    """One formatted conversation per chosen branch: ``tree, leaf, formatted, loss_spans``.

    A turn reads ``<s>role[INST]text[/INST]</s>``; control strings inside roles
    and texts are escaped. ``loss_spans`` are the (start, length) in code points
    of the assistants' texts. Tree and leaf are strings, null where the id was.
    Columns of the input that are not named play no part. An empty frame gives
    no rows.
    """
    messages = stage(clean_messages(df, tree, node, parent, role, text, score), "messages")
    paths = best_paths(messages, branches)
    turns = paths.join(messages.select("_tree", "_node", "_role", "_text"), ["_tree", "_node"]).select(
        "_tree",
        "_leaf",
        "_depth",
        (F.col("_role") == LEARNT_ROLE).alias("_learnt"),
        F.concat(F.lit(OPEN), escape(F.col("_role")), F.lit(HEAD)).alias("_before"),
        escape(F.col("_text")).alias("_body"),
    )
    turn_length = F.length("_before") + F.length("_body") + len(BODY_END) + len(CLOSE)
    earlier = (
        Window.partitionBy("_tree", "_leaf").orderBy("_depth").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = turns.withColumn("_at", F.coalesce(F.sum(turn_length).over(earlier), F.lit(0)))
    span = F.struct(
        (F.col("_at") + F.length("_before")).cast("int").alias("start"), F.length("_body").alias("length")
    )
    whole = placed.groupBy("_tree", "_leaf").agg(
        F.sort_array(
            F.collect_list(
                F.struct("_depth", F.concat("_before", "_body", F.lit(BODY_END + CLOSE)).alias("piece"), "_learnt", span.alias("span"))
            )
        ).alias("_turns")
    )
    named = lambda key: F.when(F.col(key) != NULL_KEY, F.col(key))
    return whole.select(
        named("_tree").alias("tree"),
        named("_leaf").alias("leaf"),
        F.array_join(F.transform("_turns", lambda turn: turn["piece"]), "").alias("formatted"),
        F.transform(F.filter("_turns", lambda turn: turn["_learnt"]), lambda turn: turn["span"]).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda piece: piece != "")
    body = lambda piece: F.substr(piece, F.lit(len(OPEN) + 1))
    return F.transform(
        pieces,
        lambda piece: F.struct(
            unescape(F.substring_index(body(piece), HEAD, 1)).alias("role"),
            unescape(
                F.substring_index(
                    F.substr(body(piece), F.length(F.substring_index(body(piece), HEAD, 1)) + len(HEAD) + 1),
                    BODY_END,
                    1,
                )
            ).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(spans, lambda span: unescape(F.substr(formatted, span["start"] + 1, span["length"]))), ""
    )
