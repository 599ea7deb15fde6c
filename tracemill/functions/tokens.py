"""Token sequences held as arrays: cuts, masks, padding, example assembly."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill import fixed_values as fixed
from tracemill.functions import segments
from tracemill.functions.arrays import bind, drop, head, positions, scan

IGNORED = fixed.IGNORED_LABEL
#: A word with the white space before it; white space that ends a text is a token of its own.
#: The class is spelled out, as engines differ on what white space is.
TOKEN = r"[\t\n\x0b\x0c\r ]*[^\t\n\x0b\x0c\r ]+|[\t\n\x0b\x0c\r ]+\z"


# ------------------------------------------------------------------ text side

def tokenize(text: Column) -> Column:
    """Tokens that, joined, are the text again."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(tokenize(text))


def detokenize(tokens: Column) -> Column:
    return F.array_join(tokens, "")


# ------------------------------------------------------------ seeded choices

def seeded_hash(seed: int, *keys: Column) -> Column:
    """Hex digest of key and seed: the same on every engine and every run."""
    return F.md5(F.concat_ws("|", *[key.cast("string") for key in keys], F.lit(str(seed))))


def seeded_int(bound: Column | int, seed: int, *keys: Column) -> Column:
    """A reproducible integer in ``[0, bound)``; NULL for an empty range."""
    wide = F.conv(F.substring(seeded_hash(seed, *keys), 1, 8), 16, 10).cast("long")
    limit = (F.lit(bound) if isinstance(bound, int) else bound).cast("long")
    return F.pmod(wide, F.nullif(limit, F.lit(0).cast("long")))


# ----------------------------------------------------------------------- cuts

def running_product(probabilities: Column) -> Column:
    return segments.running_product(probabilities)


def folded_product(probabilities: Column) -> Column:
    """The same as a fold inside the JVM, for comparison; numbers are not null."""
    return scan(probabilities, F.lit(1.0), lambda left, right: left * right, "double")


def likely_prefix_length(probabilities: Column, threshold: float = fixed.LIKELIHOOD_THRESHOLD) -> Column:
    """How many leading tokens keep the running product at or above ``threshold``."""
    return segments.likely_prefix_length(probabilities, threshold)


def folded_prefix_length(probabilities: Column, threshold: float = fixed.LIKELIHOOD_THRESHOLD) -> Column:
    """The same as a fold inside the JVM, for comparison; numbers are not null."""
    return F.aggregate(
        probabilities,
        F.struct(F.lit(1.0).alias("product"), F.lit(0).alias("kept")),
        lambda seen, p: F.struct(
            (seen["product"] * p).alias("product"),
            (seen["kept"] + (seen["product"] * p >= threshold).cast("int")).alias("kept"),
        ),
        lambda seen: seen["kept"],
    )


def likelihood_cut(
    state: Column, completion: Column, probabilities: Column, threshold: float = fixed.LIKELIHOOD_THRESHOLD
) -> Column:
    """State followed by the likely prefix of the completion."""
    return F.concat(state, head(completion, likely_prefix_length(probabilities, threshold)))


def strict_likelihood_cut(
    completion: Column, logprobs: Column, threshold: float, eos_id: int
) -> Column:
    """Keep tokens while the summed log probability stays above ``ln(threshold)``.

    A cut completion ends with the end token, added unless already kept last;
    an uncut one is returned as it is.
    """
    limit = F.lit(math.log(threshold) if threshold > 0 else -math.inf)
    kept = F.aggregate(
        logprobs,
        F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("kept")),
        # Once at or under the limit the total stays there, which closes the cut.
        lambda seen, lp: F.when(
            (seen["total"] > limit) & (seen["total"] + lp > limit),
            F.struct((seen["total"] + lp).alias("total"), (seen["kept"] + 1).alias("kept")),
        ).otherwise(F.struct(F.lit(float("-inf")).alias("total"), seen["kept"].alias("kept"))),
        lambda seen: seen["kept"],
    )
    prefix = head(completion, kept)
    ends_already = F.coalesce(F.try_element_at(prefix, F.lit(-1)) == eos_id, F.lit(False))
    closed = F.when(ends_already, prefix).otherwise(F.array_append(prefix, F.lit(eos_id)))
    return F.when(kept < F.size(completion), closed).otherwise(completion)


def fixed_length_cut(state: Column, code: Column, tokens_after: Column | int = fixed.TOKENS_AFTER_STATE) -> Column:
    wanted = F.lit(tokens_after) if isinstance(tokens_after, int) else tokens_after
    return head(code, F.size(state) + wanted)


def random_length_cut(state: Column, code: Column, tokens_after: int, seed: int, *keys: Column) -> Column:
    """Cut between 1 and ``tokens_after + 1`` tokens past the state, both included."""
    return fixed_length_cut(state, code, seeded_int(tokens_after + 1, seed, *keys) + 1)


def agreement_cut(state: Column, code: Column, others: Column, full_on_agreement: bool = False) -> Column:
    """Code up to the first token past the state on which some other sequence differs.

    A sequence that has ended differs. With no difference anywhere the state
    alone is kept, unless ``full_on_agreement``.
    """
    differing = F.filter(
        positions(F.size(code)),
        lambda i: (i >= F.size(state))
        & F.exists(others, lambda other: ~F.get(other, i).eqNullSafe(F.get(code, i))),
    )
    return bind(
        F.get(differing, F.lit(0)),
        lambda first: F.when(first.isNotNull(), head(code, first)).otherwise(
            code if full_on_agreement else state
        ),
    )


def random_proper_prefix(tokens: Column, seed: int, *keys: Column) -> Column:
    """Random prefix of 0 to n-1 tokens; an empty sequence stays empty."""
    return head(tokens, F.coalesce(seeded_int(F.size(tokens), seed, *keys), F.lit(0)))


def last_non_eos_index(ids: Column, eos_id: int) -> Column:
    """Position of the last token that is not the end token, -1 if there is none."""
    reversed_flags = F.transform(F.reverse(ids), lambda token: token != eos_id)
    found = F.array_position(reversed_flags, F.lit(True))
    return F.when(found > 0, F.size(ids) - found.cast("int")).otherwise(-1)


def next_state_cut(after_acceptor: Column, final_code: Column, extra: int = fixed.NEXT_STATE_TOKENS) -> Column:
    """Final code cut ``extra`` tokens past the code after the acceptor."""
    return head(final_code, F.size(after_acceptor) + extra)


def append_sampled_ids(state: Column, logprobs: Column) -> Column:
    """State ids followed by the first token id of each log-probability map.

    Maps keep the order they were written in: the sampled token comes first.
    """
    return F.concat(state, F.transform(logprobs, lambda m: F.get(F.map_keys(m), F.lit(0))))


# ------------------------------------------------------------ masks and padding

def right_pad(items: Column, filler: Column | int, length: int) -> Column:
    """Fill up to ``length``; longer rows are left whole."""
    value = F.lit(filler) if isinstance(filler, int) else filler
    missing = F.greatest(F.lit(length) - F.size(items), F.lit(0))
    return F.concat(items, F.array_repeat(value, missing))


def unpad(items: Column, filler: int = IGNORED) -> Column:
    return F.filter(items, lambda item: item != filler)


def ones(items: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(items))


def padded_pair(ids: Column, pad_id: int, max_length: int) -> Column:
    """Ids truncated and padded to ``max_length``, with their attention mask."""
    kept = head(ids, max_length)
    return F.struct(
        right_pad(kept, pad_id, max_length).alias("input_ids"),
        right_pad(ones(kept), 0, max_length).alias("attention_mask"),
    )


def offset_spans(tokens: Column) -> Column:
    """Start and end character of each token in the text they make up."""
    lengths = F.transform(tokens, F.length)
    ends = scan(lengths, F.lit(0), lambda left, right: left + right, "int")
    return F.zip_with(
        tokens,
        ends,
        lambda token, end: F.struct((end - F.length(token)).alias("start"), end.alias("end")),
    )


def kept_by_offset(spans: Column, state_length: Column) -> Column:
    """Per token: does it end past the state prompt, its closing marker left out?"""
    return bind(
        state_length - fixed.END_OF_TURN_LENGTH,
        lambda cutoff: F.transform(spans, lambda span: cutoff < span["end"] - 1),
    )


def mask_labels(ids: Column, kept: Column) -> Column:
    return F.zip_with(ids, kept, lambda token, keep: F.when(keep, token).otherwise(IGNORED))


def corrected_state(tokens: Column, kept: Column) -> Column:
    """Text after the last python fence among the tokens before the first kept one."""
    opener = fixed.PYTHON_FENCE + "\n"
    first = F.array_position(kept, F.lit(True))
    before = detokenize(head(tokens, (first - 1).cast("int")))
    return F.when(before.contains(opener), F.substring_index(before, opener, -1))


# ------------------------------------------------------------------- examples

def supervised_example(
    prompt: Column,
    state: Column,
    completion: Column,
    fence_ids: list[int],
    eos_id: int,
    pad_id: int,
    length: int = fixed.PAD_LENGTH,
) -> Column:
    """Padded ids, labels and mask; ``completion`` includes the state it continues.

    Prompt and state are masked out of the labels; what follows is learned.
    """
    closing = F.array(*[F.lit(token) for token in [*fence_ids, eos_id]])
    ids = F.concat(prompt, completion, closing)
    masked = F.size(prompt) + F.size(state)
    labels = F.concat(F.array_repeat(F.lit(IGNORED), masked), drop(ids, masked))
    return F.struct(
        right_pad(ids, pad_id, length).alias("input_ids"),
        right_pad(labels, IGNORED, length).alias("labels"),
        right_pad(ones(ids), 0, length).alias("attention_mask"),
    )


def answer_example(
    prompt: Column, answer: Column, eos_id: int, pad_id: int, length: int = fixed.PAD_LENGTH, strict: bool = True
) -> Column:
    """Supervised example without a state; a row over ``length`` is an error, or NULL if not ``strict``."""
    nothing = F.array().cast("array<int>")
    built = supervised_example(prompt, nothing, answer, [], eos_id, pad_id, length)
    too_long = F.size(prompt) + F.size(answer) + 1 > length
    if strict:
        return F.when(too_long, F.raise_error(F.lit("example too long"))).otherwise(built)
    return F.when(~too_long, built)


# -------------------------------------------------------------- probabilities

def softmax_at(logits: Column, index: Column) -> Column:
    """Probability of item ``index`` under the softmax of ``logits``."""
    wide = logits.cast("array<double>")

    def below(top: Column) -> Column:
        total = F.aggregate(wide, F.lit(0.0), lambda done, x: done + F.exp(x - top))
        return F.exp(F.element_at(wide, index + 1) - top) / total

    return bind(F.array_max(wide), below)
