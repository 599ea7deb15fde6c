"""A trie of conversation prefixes, screened by a count-min sketch.

A node is a distinct sequence of first turns; its members are the conversations
that start with it. Most prefixes belong to one conversation. A count-min
sketch of prefix digests proves that of nearly all of them, and their nodes are
written where their rows are. Only prefixes that may be shared are shuffled and
grouped exactly.

What a node sums up over its subtree is additive: every node lies on the path
of its smallest member, so its share is put on that conversation's row and
summed from the deep end of the path; a node then adds up its members' rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import stage
from tracemill.llm.sketch import Screen
from tracemill.operators.scale import MAX, SUM, XOR, global_rank, with_running

#: Characters of ids that travel in one row to where a node's ends are hashed.
CHUNK_CHARS = 1 << 16
NODE = ["depth", "x", "y"]


def number_turns(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv_id, rank, role, text``: all turns in order of conversation and turn.

    Null turns come first; equal turns follow in the order of role and text.
    Null roles and texts are empty. Rows without a conversation are left out.
    """
    given = rows.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    # Ranks come from ranges of rows, so a conversation of any length is numbered by many tasks.
    return global_rank(given, order, "rank").drop("turn")


def borrow_heads(turns: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Rebuild every conversation: the first ``head`` turns of its base, then its own after as many.

    ``turns`` is what ``number_turns`` returns; ``base`` and ``head`` are of
    ``conv_id``. A base that is absent lends nothing. Returns the turns
    (``conv_id, depth, length, role, text``, depth from 1) and all conversations
    (``conv_id, length``), which may have no turn left.
    """
    sizes = turns.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    asked = sizes.select("conv_id", "first", "n", base.alias("base"), head.alias("head"))
    lent = sizes.select(F.col("conv_id").alias("base"), F.least("n", F.lit(1 << 30)).alias("base_n"))
    taken = F.least("head", F.coalesce("base_n", F.lit(0)))
    convs = stage(
        asked.join(lent, "base", "left").withColumn("taken", taken).select(
            "conv_id",
            "first",
            "base",
            "head",
            "taken",
            (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length"),
        ),
        "conversations",
    )
    placed = turns.join(convs, "conv_id").withColumn("pos", F.col("rank") - F.col("first"))
    own = placed.where(F.col("pos") >= F.col("head")).select(
        "conv_id", (F.col("taken") + F.col("pos") - F.col("head") + 1).alias("depth"), "length", "role", "text"
    )
    most = convs.agg(F.max("head").alias("most")).scalar()
    heads = placed.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "role", "text")
    borrowed = (
        heads.join(convs.select("conv_id", "base", "head", "length"), "base")
        .where(F.col("pos") < F.col("head"))
        .select("conv_id", (F.col("pos") + 1).alias("depth"), "length", "role", "text")
    )
    return borrowed.union(own), convs.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """Every turn with the 128-bit digests ``x, y`` of all turns up to it, and ``px, py`` of those before it.

    A digest mixes one hash per turn, of its place, role and text, so digests
    of any length are running values that need no task to read a conversation whole.
    """
    hashed = turns.select(
        "conv_id",
        "depth",
        "length",
        "role",
        "text",
        (F.col("depth") - 1).alias("pos"),
        F.xxhash64(F.lit(1), "depth", "role", "text").alias("a"),
        F.xxhash64(F.lit(2), "depth", "role", "text").alias("b"),
    )
    run = with_running(hashed, ["conv_id"], "pos", {"x": (XOR, F.col("a")), "y": (XOR, F.col("b"))})
    return run.select(
        "conv_id",
        "depth",
        "length",
        "role",
        "text",
        "x",
        "y",
        F.col("x").bitwiseXOR(F.col("a")).alias("px"),
        F.col("y").bitwiseXOR(F.col("b")).alias("py"),
    )


def hashed_ends(ends: DataFrame) -> DataFrame:
    """``depth, x, y, ends``: SHA-256 of the ids (``conv_id``) of each node, ascending, joined by commas.

    Ids are put in order by range, so a node of any number of ends is written
    out by many tasks; the one that hashes it reads long pieces, one at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, None, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"depth": node[0], "x": node[1], "y": node[2], "first": first, "piece": ",".join(held)}],
                pa.schema([*[(name, pa.int64()) for name in (*NODE, "first")], ("piece", pa.string())]),
            )

        for batch in batches:
            for *own, conv in zip(*(column.to_pylist() for column in batch.columns)):
                if held and (own != node or size > CHUNK_CHARS):
                    yield row()
                    held, size = [], 0
                if not held:
                    node, first = own, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"depth": node[0], "x": node[1], "y": node[2], "ends": state.hexdigest()}],
                pa.schema([*[(name, pa.int64()) for name in NODE], ("ends", pa.string())]),
            )

        for batch in batches:
            for *own, _, piece in zip(*(column.to_pylist() for column in batch.columns)):
                if own != node:
                    if node is not None:
                        yield row()
                    node, state = own, hashlib.sha256()
                    state.update(piece.encode())
                else:
                    state.update(b"," + piece.encode())
        if node is not None:
            yield row()

    ordered = [*NODE, "conv_id"]
    pieces = (
        ends.select(*[F.col(name).cast("long") for name in ordered])
        .repartitionByRange(*ordered)
        .sortWithinPartitions(*ordered)
        .mapInArrow(join, "depth long, x long, y long, first long, piece string")
    )
    return (
        pieces.repartition(*NODE)
        .sortWithinPartitions(*NODE, "first")
        .mapInArrow(digest, "depth long, x long, y long, ends string")
    )


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the trie of conversations.

    ``turns`` holds ``conv_id, depth, length, role, text`` with depths from 1 to
    the conversation's ``length``, none of them null; ``convs`` holds all
    conversations (``conv_id, length``, unique), those without turns too. Both
    are what ``borrow_heads`` returns.

    Returns, per node: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``,
    ``n_leaves`` (childless nodes below it, itself included), ``saved_tokens``
    (over its subtree, members but one times bytes of the last text) and
    ``ends_sha256`` (of the ids of members that end there, ascending, joined by
    commas). Two sequences are one node if their 128-bit digests and their last
    turns agree. Without conversations there is no node.
    """
    rows = stage(prefixes(turns), "prefixes")
    screen = Screen(rows, NODE, by_row=True)
    depth = F.col("depth")
    # Past a prefix that is proven to have one member there is no other either.
    maybe = screen.may_repeat(*[F.col(name) for name in NODE])
    parent_maybe = (depth == 1) | screen.may_repeat(depth - 1, F.col("px"), F.col("py"))
    asked = rows.withColumns({"maybe": maybe, "parent_maybe": parent_maybe})
    shared = asked.where("maybe AND parent_maybe").drop("maybe", "parent_maybe")
    zero = F.lit(0).cast("long")
    roots = convs.select(
        "conv_id",
        zero.alias("depth"),
        F.col("length").cast("long").alias("length"),
        F.lit("").alias("role"),
        F.lit("").alias("text"),
        *[zero.alias(name) for name in ("x", "y", "px", "py")],
    )
    paths = stage(shared.unionByName(roots), "shared")

    ends = F.col("depth") == F.col("length")
    nodes = stage(
        paths.groupBy(*NODE, "px", "py", "role", "text")
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(ends).alias("n_ends"))
        .withColumn("weight", (F.col("n_convs") - 1) * F.octet_length("text"))
        .drop("role", "text"),
        "nodes",
    )
    first = nodes.select("conv_id", "depth", "weight", (F.col("n_ends") == F.col("n_convs")).alias("childless"))
    path = paths.drop("role", "text").join(first, ["conv_id", "depth"], "left")
    is_first = F.col("weight").isNotNull()
    below = path.select("conv_id", (depth - 1).alias("depth"), is_first.cast("long").alias("below"))
    summed = with_running(
        path.withColumn("from_end", F.col("length") - depth),
        ["conv_id"],
        "from_end",
        {
            "saved": (SUM, F.col("weight")),
            "end_seen": (MAX, ends.cast("long")),
            "leaf_seen": (MAX, (ends & is_first & F.coalesce("childless", F.lit(False))).cast("long")),
        },
    )
    # A next prefix, or an end, that is not among the shared ones has this conversation alone.
    share = summed.join(below, ["conv_id", "depth"], "left").select(
        "conv_id",
        *NODE,
        "px",
        "py",
        ends.alias("ends"),
        F.coalesce("saved", zero).alias("saved"),
        F.when(F.col("end_seen") == 1, F.col("leaf_seen")).otherwise(1).alias("leaf"),
        F.when(ends, zero).otherwise(F.coalesce("below", F.lit(1).cast("long"))).alias("child"),
    )
    exact = share.groupBy(*NODE, "px", "py").agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.sum("child").alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
        F.count_if("ends").alias("n_ends"),
        F.min(F.when(F.col("ends"), F.col("conv_id"))).alias("only_end"),
    )
    exact = stage(exact, "exact")

    several = exact.where("n_ends > 1").select(*NODE)
    ended = hashed_ends(paths.where(ends).join(several, NODE, "left_semi"))
    few = F.sha2(F.coalesce(F.col("only_end").cast("string"), F.lit("")).cast("binary"), 256)
    parents = nodes.select(
        (depth + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("above")
    ).where("depth > 1")
    root = convs.agg(F.min("conv_id")).scalar()
    above = F.when(depth == 1, root).when(depth > 1, F.coalesce("above", "conv_id"))
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    whole = (
        exact.join(ended, NODE, "left")
        .join(parents, ["depth", "px", "py"], "left")
        .select(
            "conv_id",
            "depth",
            above.alias("parent_conv_id"),
            *figures,
            F.coalesce("ends", few).alias("ends_sha256"),
        )
    )
    tails = asked.where("NOT (maybe AND parent_maybe)")
    own = F.when(depth == F.col("length"), F.col("conv_id").cast("string")).otherwise("")

    def alone(rows: DataFrame, above: Column) -> DataFrame:
        one = F.lit(1).cast("long")
        return rows.select(
            "conv_id",
            "depth",
            above.alias("parent_conv_id"),
            one.alias("n_convs"),
            (depth < F.col("length")).cast("long").alias("n_children"),
            one.alias("n_leaves"),
            zero.alias("saved_tokens"),
            F.sha2(own.cast("binary"), 256).alias("ends_sha256"),
        )

    local = alone(tails.where("NOT parent_maybe OR depth = 1"), F.when(depth == 1, root).otherwise(F.col("conv_id")))
    # The first turn after a shared prefix: one per conversation, and the only tails that ask for their parent.
    leaving = tails.where("parent_maybe AND depth > 1").join(parents, ["depth", "px", "py"], "left")
    return whole.union(local).union(alone(leaving, F.coalesce("above", "conv_id")))
