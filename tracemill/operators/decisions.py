"""The acceptor's decision from its next-token log probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import fixed_values as fixed
from tracemill.functions.text import normalise_token

#: Ids that read as an action, up to which a row's map is read in place.
ACTION_IDS = 256


def decide(tokens: DataFrame, keys: Sequence[str], text: str = "token_text", logprob: str = "logprob") -> DataFrame:
    """One decision per key from rows of (token text, log probability).

    Probabilities of tokens that read as an action are added up per action.
    With no such token the decision is to reject. Ties go to the action named
    first. Sums are partial per task, so a key of any size is fine.
    """
    word = normalise_token(F.col(text))
    sums = tokens.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when(word == action, F.exp(logprob))), F.lit(0.0)).alias(f"_{action}")
            for action in fixed.ACTIONS
        ]
    )
    return _settle(sums, keys)


def _settle(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The decision from the probability of each action, under the action's name with an underscore."""
    accept, reject, finish = (F.col(f"_{action}") for action in fixed.ACTIONS)
    settled = sums.withColumn(
        "_reject", F.when(F.greatest(accept, reject, finish) == 0, F.lit(1.0)).otherwise(reject)
    )
    return settled.select(
        *keys,
        F.when((accept >= reject) & (accept >= finish), "accept")
        .when(reject >= finish, "reject")
        .otherwise("finish")
        .alias("action"),
        (accept / (accept + reject + finish)).alias("accept_prob"),
        F.ln(F.greatest(accept, reject, finish)).alias("logprob"),
    )


def top_token_rows(infos: DataFrame, keys: Sequence[str], column: str = "all_logprobs") -> DataFrame:
    """Unfold a map of token id to log probability into rows."""
    return infos.select(*keys, F.explode(column).alias("token_id", "logprob"))


def action_ids(vocabulary: DataFrame) -> DataFrame:
    """``token_id, word``: the entries of a vocabulary that read as an action, in any case and spacing."""
    word = normalise_token(F.col("token"))
    return vocabulary.where(word.isin(*fixed.ACTIONS)).select("token_id", word.alias("word"))


def decide_from_logprobs(
    infos: DataFrame, vocabulary: DataFrame, keys: Sequence[str], column: str = "all_logprobs"
) -> DataFrame:
    """One decision per row of ``infos`` from its map of token id to log probability.

    Ids become text by the vocabulary. Only the few that read as an action
    matter, so those are all of the vocabulary that rows ever meet: inside the
    row, without a shuffle, where there are at most ``ACTION_IDS`` of them, and by
    join otherwise. Ids unknown to the vocabulary and missing probabilities count
    for nothing, a map without an action is a reject, and a row without a map
    has no decision. ``keys`` name a row.
    """
    words = action_ids(vocabulary)
    given = infos.where(F.col(column).isNotNull())
    few = words.limit(ACTION_IDS + 1).collect()
    if len(few) > ACTION_IDS:
        return _decide_by_join(given, words, keys, column)

    def chance(action: str) -> Column:
        own = [row["token_id"] for row in few if row["word"] == action]
        of_action = F.filter(F.map_entries(column), lambda entry: entry["key"].isin(own))
        return F.aggregate(
            of_action, F.lit(0.0), lambda done, entry: done + F.coalesce(F.exp(entry["value"]), F.lit(0.0))
        )

    return _settle(given.select(*keys, *[chance(a).alias(f"_{a}") for a in fixed.ACTIONS]), keys)


def _decide_by_join(infos: DataFrame, words: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The same for any number of action ids; entries of other ids never leave their task."""
    rows = top_token_rows(infos, keys, column)
    met = rows.join(words, "token_id").groupBy(*keys).agg(
        *[F.sum(F.when(F.col("word") == action, F.exp("logprob"))).alias(f"_{action}") for action in fixed.ACTIONS]
    )
    every = infos.select(*keys).join(met, [*keys], "left")
    filled = {f"_{action}": F.coalesce(f"_{action}", F.lit(0.0)) for action in fixed.ACTIONS}
    return _settle(every.withColumns(filled), keys)
