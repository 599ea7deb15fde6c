"""Vocabulary table, and token arrays to ids and back.

A vocabulary that is measured to be small is looked up inside the row: whole
Arrow arrays against a broadcast table, with no row per token, no join and no
gathering. A larger one is met by join.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.segments import item_lists
from tracemill.functions.tokens import detokenize
from tracemill.operators.scale import global_rank, kept_table, salted_join

# A vocabulary measured to stay under this size is broadcast whole.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 64
# In a larger one, a token of rank r makes up at most 1/r of all tokens. So the
# first ranks hold every token that could be hot, and are few enough to
# broadcast: at most HEAD_RANKS * HEAD_TOKEN_CHARS characters. A longer token
# than that cannot be hot among tokens of ordinary length.
HEAD_RANKS = 200_000
HEAD_TOKEN_CHARS = 256
# Other texts than the vocabulary's own may favour a token of the tail, so
# lookups in the tail are salted unless the caller says the texts are its own.
TAIL_SALTS = 8


def build_vocabulary(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(token, token_id, frequency); ids rank tokens by frequency, then by text."""
    counted = tokens.groupBy(F.col(token).alias("token")).agg(F.count("*").alias("frequency"))
    ranked = global_rank(counted, [F.desc("frequency"), F.asc("token")], "token_id")
    # Read many times from here on: kept as a table rather than ranked again.
    return kept_table(ranked.withColumn("token_id", F.col("token_id").cast("int")))


def fits_broadcast(vocabulary: DataFrame) -> bool:
    """Measure the vocabulary table; two numbers come back to the driver."""
    size = F.coalesce(F.sum(F.octet_length("token") + ROW_BYTES), F.lit(0))
    return vocabulary.agg(size.alias("size")).first()["size"] <= BROADCAST_BYTES


class Held:
    """A vocabulary opened in a worker: its columns, and hash indexes on both, built once."""

    def __init__(self, table: pa.Table) -> None:
        self.tokens = table.column("token").combine_chunks()
        self.token_ids = table.column("token_id").combine_chunks()
        self._by_token = pd.Index(self.tokens.to_numpy(zero_copy_only=False), dtype=object)
        self._by_id = pd.Index(self.token_ids.to_numpy(zero_copy_only=False))

    @staticmethod
    def _places(index: pd.Index, items: pa.Array, values: np.ndarray) -> pa.Array:
        found = index.get_indexer(values) if len(items) else np.empty(0, np.int64)
        missing = found < 0
        if items.null_count:
            missing |= items.is_null().to_numpy(zero_copy_only=False)
        return pa.array(found, pa.int64(), mask=missing)

    def token_places(self, items: pa.Array) -> pa.Array:
        """Rows of the vocabulary holding these tokens, null for an unknown or null token."""
        return self._places(self._by_token, items, items.to_numpy(zero_copy_only=False))

    def id_places(self, items: pa.Array) -> pa.Array:
        """Rows of the vocabulary holding these ids, null for an unknown or null id."""
        ids = items.cast(self.token_ids.type)
        return self._places(self._by_id, ids, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False))


# Opened vocabularies of this Python worker, by lookup: read and indexed once,
# not again for every batch.
_opened: dict[str, Held] = {}
#: So many of them at most: a worker outlives the queries it serves.
OPENED = 2


def _held(vocabulary: DataFrame) -> Callable[[], Held]:
    """The vocabulary as a broadcast Arrow table, opened once per worker; measure it first."""
    table = vocabulary.select("token", "token_id").toArrow().combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    content = vocabulary.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    key = uuid.uuid4().hex

    def opened() -> Held:
        if key not in _opened:
            while len(_opened) >= OPENED:
                del _opened[next(iter(_opened))]
            _opened[key] = Held(pa.ipc.open_stream(content.value).read_all())
        return _opened[key]

    return opened


class Lookup:
    """Columns that read a vocabulary inside the row; ask ``fits_broadcast`` first."""

    def __init__(self, vocabulary: DataFrame) -> None:
        self._open = _held(vocabulary)
        self._id_type = vocabulary.schema["token_id"].dataType

    def ids(self, tokens: Column) -> Column:
        """Ids of an array of tokens, null for a token that is unknown; no array gives an empty one."""
        opened = self._open

        def look_up(lists: pa.Array) -> pa.Array:
            held = opened()
            items, offsets = item_lists(lists)
            return pa.ListArray.from_arrays(offsets, pc.take(held.token_ids, held.token_places(items)))

        return F.arrow_udf(look_up, T.ArrayType(self._id_type))(tokens)

    def text(self, ids: Column) -> Column:
        """The tokens of an array of ids, joined; ids that are unknown are left out, no array is no text."""
        opened = self._open

        def look_up(lists: pa.Array) -> pa.Array:
            held = opened()
            items, offsets = item_lists(lists)
            tokens = pc.fill_null(pc.take(held.tokens, held.id_places(items)), "")
            return pc.binary_join(pa.ListArray.from_arrays(offsets, tokens), "")

        return F.arrow_udf(look_up, "string")(ids)


def head_and_tail(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``token, token_id`` of the frequent entries, few enough to broadcast, and of all others."""
    entries = vocabulary.select("token", "token_id")
    is_head = (F.col("token_id") <= HEAD_RANKS) & (F.length("token") <= HEAD_TOKEN_CHARS)
    return entries.where(is_head), entries.where(~is_head)


def _look_up(items: DataFrame, keys: Sequence[str], vocabulary: DataFrame, by: str, own_texts: bool) -> DataFrame:
    """Left join items to a vocabulary past the broadcast size, on ``token`` or ``token_id``.

    Frequent entries are still met by broadcast and only the long tail is joined
    by shuffle.
    """
    head, tail = head_and_tail(vocabulary)
    frequent = F.broadcast(head)
    found = F.col("token_id" if by == "token" else "token").isNotNull()
    near = items.join(frequent, by, "left").where(found | F.col(by).isNull())
    far = items.where(F.col(by).isNotNull()).join(frequent, by, "left_anti")
    if own_texts:
        return near.unionByName(far.join(tail, by, "left"))
    return near.unionByName(salted_join(far, tail, [by], [*keys, "_pos"], "left", TAIL_SALTS))


def encode(
    df: DataFrame,
    keys: Sequence[str],
    tokens: str,
    vocabulary: DataFrame,
    keep_tokens: bool = False,
    own_texts: bool = False,
) -> DataFrame:
    """Keys with ``ids``, the token ids in order (NULL for an unknown token).

    ``own_texts``: the vocabulary was built from these very texts.
    """
    if fits_broadcast(vocabulary):
        kept = [F.coalesce(F.col(tokens), F.array().cast("array<string>")).alias("tokens")] if keep_tokens else []
        return df.select(*keys, Lookup(vocabulary).ids(F.col(tokens)).alias("ids"), *kept)
    items = df.select(*keys, F.posexplode_outer(tokens).alias("_pos", "token"))
    fields = ["_pos", "token_id"] + (["token"] if keep_tokens else [])
    found = F.when(F.col("_pos").isNotNull(), F.struct(*fields))
    rows = (
        _look_up(items, keys, vocabulary, "token", own_texts)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(found)).alias("_found"))
    )
    wanted = [F.col("_found.token_id").alias("ids")]
    if keep_tokens:
        wanted.append(F.col("_found.token").alias("tokens"))
    return rows.select(*keys, *wanted)


def decode(
    df: DataFrame,
    keys: Sequence[str],
    ids: str,
    vocabulary: DataFrame,
    special_ids: Sequence[int] = (),
    own_texts: bool = False,
) -> DataFrame:
    """Keys with ``text``: the tokens of ``ids`` joined, special ids left out."""
    kept = F.filter(ids, lambda token: ~token.isin(*special_ids)) if special_ids else F.col(ids)
    if fits_broadcast(vocabulary):
        return df.select(*keys, Lookup(vocabulary).text(kept).alias("text"))
    items = df.select(*keys, F.posexplode_outer(kept).alias("_pos", "token_id"))
    found = F.when(F.col("_pos").isNotNull(), F.struct("_pos", "token"))
    rows = (
        _look_up(items, keys, vocabulary, "token_id", own_texts)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(found)).alias("_found"))
    )
    return rows.select(*keys, detokenize(F.col("_found.token")).alias("text"))
