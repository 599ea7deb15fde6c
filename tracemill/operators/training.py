"""The training table: from a state and its completion to masked rows of fixed length.

Texts become chats, chats become tokens with their characters' places, and
places become labels, all inside the row. Only the rare tokens of a vocabulary
past the broadcast size need a join.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import fixed_values as fixed
from tracemill.functions.arrays import drop
from tracemill.functions.prompts import assistant_prompt, render_chat
from tracemill.functions.segments import item_lists
from tracemill.functions.tokens import TOKEN, ones, right_pad, tokenize
from tracemill.operators.examples import drop_throwouts, of_length, with_labels
from tracemill.operators.scale import salted_join
from tracemill.operators.vocabulary import TAIL_SALTS, Held, Lookup, fits_broadcast, head_and_tail

RESPONSE, TEMPLATE = "assistant_prompt_response", "chat_template_state"
LABELLED = "struct<ids: array<int>, labels: array<int>, start: int>"
PLACED = "struct<ids: array<int>, first: int, start: int, unknown: array<string>>"
#: Texts whose tokens a worker holds at once.
PLACED_ROWS = 512


def format_examples(df: DataFrame, state: str = "state", completion: str = "correct_completion") -> DataFrame:
    """Add the chat that ends with the completion, and the one that ends with the state alone.

    A state that is missing is empty, and a missing completion is the state.
    """
    code = F.coalesce(F.col(state), F.lit(""))
    return df.withColumns(
        {
            RESPONSE: render_chat(assistant_prompt(code, F.col(completion))),
            TEMPLATE: render_chat(assistant_prompt(code)),
        }
    )


def response_tokens(df: DataFrame) -> DataFrame:
    """``token``: every token of every response, to build a vocabulary from."""
    return df.select(F.explode(tokenize(F.col(RESPONSE))).alias("token"))


def _first_labels(items: pa.Array, bounds: np.ndarray, cutoffs: pa.Array, length: int) -> tuple[np.ndarray, ...]:
    """Of lists of tokens that lie end to end: which tokens are among the first ``length``, which of those
    end past their list's cutoff, and the first character of the first of them, -1 if there is none."""
    sizes = np.diff(bounds)
    # Ends of all tokens counted through the batch, less where their own text begins.
    ends = np.concatenate([[0], np.cumsum(pc.utf8_length(items).to_numpy(zero_copy_only=False))])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(rows)) - bounds[:-1][rows]
    within = place < length
    own_end = ends[1:] - ends[bounds[:-1]][rows]
    kept = within & (cutoffs.to_numpy(zero_copy_only=False)[rows] < own_end - 1)
    starts = np.full(len(sizes), -1, np.int64)
    found = np.flatnonzero(kept)[::-1]
    starts[rows[found]] = ends[:-1][found] - ends[bounds[:-1]][rows[found]]
    return within, kept, starts


def _labelled_in_row(lookup: Lookup, tokens: Column, cutoff: Column, length: int) -> Column:
    """``ids, labels, start`` of the first ``length`` tokens: labels of those that end past ``cutoff``.

    ``start`` is the first character of the first of them, null if there is none.
    """
    opened = lookup._open
    ignored = fixed.IGNORED_LABEL

    def label(lists: pa.Array, cutoffs: pa.Array) -> pa.Array:
        held = opened()
        items, offsets = item_lists(lists)
        known = pc.take(held.token_ids, held.token_places(items))
        bounds = offsets.to_numpy()
        within, kept, starts = _first_labels(items, bounds, cutoffs, length)
        new_bounds = np.concatenate([[0], np.cumsum(np.minimum(np.diff(bounds), length))]).astype(np.int32)
        taken = pa.array(within)
        ids = known.cast(pa.int32()).filter(taken)
        labels = pc.if_else(pa.array(kept), known.cast(pa.int32()), pa.scalar(ignored, pa.int32())).filter(taken)
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array(new_bounds), ids),
                pa.ListArray.from_arrays(pa.array(new_bounds), labels),
                pa.array(starts, pa.int32(), mask=starts < 0),
            ],
            names=["ids", "labels", "start"],
        )

    return F.arrow_udf(label, LABELLED)(tokens, cutoff)


def _placed_in_row(lookup: Lookup, text: Column, cutoff: Column, length: int) -> Column:
    """``ids, first, start, unknown`` of the first ``length`` tokens of a text, from a part of the vocabulary.

    ``unknown`` are the tokens not found there, in order; their ids are null.
    ``first`` is the place, from 0, of the first token that ends past ``cutoff``
    (all after it do), and ``start`` its first character; null if there is none.
    """
    opened = lookup._open
    pattern = TOKEN.replace(r"\z", r"\Z")

    def place_some(held: Held, lists: list[list[str]], cutoffs: pa.Array) -> pa.Array:
        items = pa.array(itertools.chain.from_iterable(lists), pa.string())
        bounds = np.concatenate([[0], np.cumsum([len(tokens) for tokens in lists], dtype=np.int64)])
        _, kept, starts = _first_labels(items, bounds, cutoffs, length)
        ids = pc.take(held.token_ids, held.token_places(items)).cast(pa.int32())
        unknown = pc.is_null(ids)
        masked = np.concatenate([[0], np.cumsum(~kept)])
        gaps = np.concatenate([[0], np.cumsum(unknown.to_numpy(zero_copy_only=False))])
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), ids),
                pa.array(np.diff(masked[bounds]), pa.int32(), mask=starts < 0),
                pa.array(starts, pa.int32(), mask=starts < 0),
                pa.ListArray.from_arrays(pa.array(gaps[bounds], pa.int32()), items.filter(unknown)),
            ],
            names=["ids", "first", "start", "unknown"],
        )

    def place(texts: pa.Array, cutoffs: pa.Array) -> pa.Array:
        held, found = opened(), re.compile(pattern).findall
        parts = []
        for at in range(0, len(texts), PLACED_ROWS):
            lists = [found(x or "")[:length] for x in texts.slice(at, PLACED_ROWS).to_pylist()]
            parts.append(place_some(held, lists, cutoffs.slice(at, PLACED_ROWS)))
        return pa.concat_arrays(parts) if parts else place_some(held, [], cutoffs)

    # Else filters on what it returns would have it run once more.
    return F.arrow_udf(place, PLACED).asNondeterministic()(text, cutoff)


def _filled(ids: Column, unknown: Column, tokens: Column, token_ids: Column) -> Column:
    """``ids`` with their nulls filled: the ids of ``unknown``, in order, from ``tokens`` and ``token_ids``."""

    def fill(lists: pa.Array, missing: pa.Array, found: pa.Array, found_ids: pa.Array) -> pa.Array:
        items, offsets = item_lists(lists)
        # A token has the same id in all rows, so those of a batch are looked up together.
        places = pc.index_in(item_lists(missing)[0], value_set=item_lists(found)[0])
        known = pc.take(item_lists(found_ids)[0], places)
        return pa.ListArray.from_arrays(offsets, pc.replace_with_mask(items, pc.is_null(items), known))

    return F.arrow_udf(fill, "array<int>").asNondeterministic()(ids, unknown, tokens, token_ids)


def _rest_by_join(rows: DataFrame, placed: DataFrame, vocabulary: DataFrame, own_texts: bool) -> DataFrame:
    """``rows`` with the nulls of ``_ids`` filled; ``_unknown`` are their tokens, ``_print`` what both depend on.

    ``placed`` has ``_print`` and ``_unknown`` of the same rows. Only tokens that
    are not among the frequent ones travel, each once per row, and texts do not.
    """
    tail = head_and_tail(vocabulary)[1]
    items = placed.select("_print", F.explode(F.array_distinct("_unknown")).alias("token"))
    if own_texts:
        met = items.join(tail, "token")
    else:
        met = salted_join(items, tail, ["token"], ["_print"], salts=TAIL_SALTS)
    # Rows of one print have the same tokens.
    found = met.groupBy("_print").agg(F.collect_set(F.struct("token", "token_id")).alias("_found"))
    ids = _filled(F.col("_ids"), F.col("_unknown"), F.col("_found.token"), F.col("_found.token_id"))
    return rows.join(found, "_print", "left").withColumn("_ids", ids).drop("_found", "_unknown", "_print")


def tokenize_examples(
    df: DataFrame,
    vocabulary: DataFrame,
    keys: Sequence[str],
    pad_id: int,
    length: int = fixed.PAD_LENGTH,
    own_texts: bool = False,
) -> DataFrame:
    """Add ``input_ids, labels, attention_mask, throwout`` to formatted examples and correct their ``state``.

    A response is cut at ``length`` tokens and padded to it. Labels are those of
    tokens that end past the state's chat, its closing marker left out. A row
    without one is flagged to be thrown out and has the state's chat as its
    state; for others the state is the text between the last python fence and the
    first label, null where there is no fence. Where the vocabulary is too large
    to be looked up in the row, its frequent tokens are, and the others are met by
    join; ``own_texts``: it was built from these very texts.
    """
    cutoff = (F.length(TEMPLATE) - fixed.END_OF_TURN_LENGTH).cast("int")
    whole = fits_broadcast(vocabulary)
    if whole:
        row = _labelled_in_row(Lookup(vocabulary), tokenize(F.col(RESPONSE)), cutoff, length)
        rows = df.withColumn("_row", row)
        rows = rows.withColumns({"_ids": F.col("_row.ids"), "_labels": F.col("_row.labels")})
    else:
        lookup = Lookup(head_and_tail(vocabulary)[0])
        row = _placed_in_row(lookup, F.col(RESPONSE), cutoff, length)
        text = F.struct(F.xxhash64(RESPONSE, *keys), F.xxhash64(*keys, RESPONSE))
        rows = df.withColumns({"_row": row, "_print": text})
        rows = rows.withColumns(
            {"_ids": F.col("_row.ids"), "_first": F.col("_row.first"), "_unknown": F.col("_row.unknown")}
        )
    placed = rows
    start, opener = F.col("_row.start"), fixed.PYTHON_FENCE + "\n"
    before = F.substring(F.col(RESPONSE), F.lit(1), start)
    corrected = F.when(before.contains(opener), F.substring_index(before, opener, -1))
    rows = rows.withColumns(
        {
            "state": F.when(start.isNull(), F.col(TEMPLATE)).otherwise(corrected),
            "throwout": start.isNull(),
        }
    ).drop("_row")
    if not whole:
        masked = F.coalesce("_first", F.size("_ids"))
        labels = F.concat(F.array_repeat(F.lit(fixed.IGNORED_LABEL), masked), drop(F.col("_ids"), masked))
        rows = _rest_by_join(rows, placed, vocabulary, own_texts).withColumn("_labels", labels).drop("_first")
    return rows.withColumns(
        {
            "input_ids": right_pad(F.col("_ids"), pad_id, length),
            "labels": right_pad(F.col("_labels"), fixed.IGNORED_LABEL, length),
            "attention_mask": right_pad(ones(F.col("_ids")), 0, length),
        }
    ).drop("_ids", "_labels")


def training_table(
    df: DataFrame,
    vocabulary: DataFrame,
    keys: Sequence[str],
    pad_id: int,
    length: int = fixed.PAD_LENGTH,
    own_texts: bool = False,
) -> DataFrame:
    """Formatted examples to the rows to learn from: tokenised, labelled, and of ``length`` tokens.

    All columns of ``df`` stay. Rows to be thrown out and rows without a label go.
    """
    return (
        tokenize_examples(df, vocabulary, keys, pad_id, length, own_texts)
        .transform(drop_throwouts)
        .transform(with_labels)
        .transform(of_length, length=length)
    )
