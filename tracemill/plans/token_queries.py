"""Vocabulary, cuts, labels, padding and supervised examples over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill import fixed_values as fixed
from tracemill.functions import tokens
from tracemill.functions.arrays import head, join_items
from tracemill.operators import examples, metrics, quality
from tracemill.operators.vocabulary import decode
from tracemill.plans import views
from tracemill.plans.registry import query, round_all
from tracemill.plans.views import EOS_ID, FENCE_IDS, PAD_ID, SEED

MAX_LENGTH = 64
PAIR_LENGTH = 256


def text_of(column: str, name: str | None = None):
    return join_items(F.col(column)).alias(name or column)


# ----------------------------------------------------------------- vocabulary

@query(
    "tokenize_t1",
    "SELECT doc_id, len(ids)::INT AS n_tokens, array_to_string(ids, ',') AS ids FROM v_tokens",
)
def tokenize(spark, sf):
    return views.token_ids(spark, sf).select("doc_id", F.size("ids").alias("n_tokens"), text_of("ids"))


@query("vocabulary_t1", "SELECT token, id AS token_id, frequency FROM v_vocab")
def vocabulary(spark, sf):
    return views.vocabulary(spark, sf)


@query("decode_t2", "SELECT doc_id, array_to_string(tokens, '') AS text FROM v_tokens")
def decode_ids(spark, sf):
    """Decode with an end token put after each document, to be skipped."""
    rows = views.token_ids(spark, sf).select("doc_id", F.array_append("ids", F.lit(EOS_ID)).alias("ids"))
    return decode(rows, ["doc_id"], "ids", views.vocabulary(spark, sf), special_ids=[EOS_ID], own_texts=True)


def padded_sql(column: str) -> str:
    return f"""array_to_string(list_resize({column}[1:{PAIR_LENGTH}], {PAIR_LENGTH}, {PAD_ID}), ',') AS {column},
        array_to_string(list_resize([1 for x in {column}[1:{PAIR_LENGTH}]], {PAIR_LENGTH}, 0), ',') AS {column}_mask"""


@query("tokenize_pair_t3", f"SELECT doc_id, {padded_sql('ids')}, {padded_sql('state_ids')} FROM v_tokens")
def tokenize_pair(spark, sf):
    rows = views.token_ids(spark, sf)
    for name in ("ids", "state_ids"):
        rows = rows.withColumn(f"_{name}", tokens.padded_pair(F.col(name), PAD_ID, PAIR_LENGTH))
    return rows.select(
        "doc_id",
        *[
            part
            for name in ("ids", "state_ids")
            for part in (
                text_of(f"_{name}.input_ids", name),
                text_of(f"_{name}.attention_mask", f"{name}_mask"),
            )
        ],
    )


# ----------------------------------------------------------------------- cuts

RUNNING = """SELECT *, product(prob) OVER w AS running, sum(ln(prob)) OVER w AS total FROM v_tokprob
    WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"""
CUT = """SELECT t.doc_id, t.ids, t.state_ids, coalesce(kept, 0) AS kept
    FROM v_tokens t LEFT JOIN (SELECT doc_id, count(*) FILTER (running >= 0.8) AS kept FROM running GROUP BY doc_id)
    USING (doc_id)"""


# A windowed product() multiplies in tree order; this one goes token by token.
IN_ORDER = """SELECT doc_id, list_reduce(list([prob] ORDER BY pos), lambda done, p: list_append(done, done[-1] * p[1]))
    AS products FROM v_tokprob GROUP BY doc_id"""


@query(
    "running_product_w7",
    """SELECT doc_id, (generate_subscripts(products, 1) - 1)::INT AS pos, round(unnest(products), 6) AS running
       FROM in_order""",
    in_order=IN_ORDER,
)
def running_product(spark, sf):
    running = tokens.running_product(F.col("probs"))
    rows = views.token_probabilities(spark, sf).select("doc_id", F.posexplode(running).alias("pos", "running"))
    return round_all(rows)


@query(
    "likelihood_cut_t5",
    "SELECT doc_id, array_to_string(ids[1:len(state_ids) + kept], ',') AS kept_ids FROM cut",
    running=RUNNING,
    cut=CUT,
)
def likelihood_cut(spark, sf):
    kept = tokens.likelihood_cut(F.col("state_ids"), F.col("completion_ids"), F.col("probs"))
    return views.token_probabilities(spark, sf).select("doc_id", join_items(kept).alias("kept_ids"))


@query(
    "strict_cut_t6",
    f"""SELECT t.doc_id, array_to_string(ids[len(state_ids) + 1:len(state_ids) + coalesce(k.kept, 0)]
               || CASE WHEN coalesce(k.kept, 0) < len(ids) - len(state_ids) THEN [{EOS_ID}] ELSE []::INT[] END, ',') AS kept_ids
        FROM v_tokens t
        LEFT JOIN (SELECT doc_id, count(*) FILTER (total > ln(0.8)) AS kept FROM running GROUP BY doc_id) k
        USING (doc_id)""",
    running=RUNNING,
)
def strict_cut(spark, sf):
    logprobs = F.transform("probs", lambda p: F.ln(p))
    kept = tokens.strict_likelihood_cut(F.col("completion_ids"), logprobs, 0.8, EOS_ID)
    return views.token_probabilities(spark, sf).select("doc_id", join_items(kept).alias("kept_ids"))


@query(
    "kept_length_a8",
    "SELECT round(avg(kept), 6) AS mean_kept_length FROM cut",
    running=RUNNING,
    cut=CUT,
)
def kept_length(spark, sf):
    rows = views.token_probabilities(spark, sf).withColumn(
        "kept_ids", tokens.likelihood_cut(F.col("state_ids"), F.col("completion_ids"), F.col("probs"))
    )
    return round_all(metrics.kept_length(rows, "kept_ids", "state_ids"))


@query(
    "fixed_length_cut_t7",
    "SELECT doc_id, array_to_string(ids[1:len(state_ids) + 20], ',') AS kept_ids FROM v_tokens",
)
def fixed_length_cut(spark, sf):
    kept = tokens.fixed_length_cut(F.col("state_ids"), F.col("ids"))
    return views.token_ids(spark, sf).select("doc_id", join_items(kept).alias("kept_ids"))


DOC_DRAW = f"('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, '{SEED}')), 1, 8))::BIGINT"


@query(
    "random_length_cut_t8",
    f"SELECT doc_id, array_to_string(ids[1:len(state_ids) + 1 + {DOC_DRAW} % 21], ',') AS kept_ids FROM v_tokens",
)
def random_length_cut(spark, sf):
    kept = tokens.random_length_cut(
        F.col("state_ids"), F.col("ids"), fixed.TOKENS_AFTER_STATE, SEED, F.col("doc_id")
    )
    return views.token_ids(spark, sf).select("doc_id", join_items(kept).alias("kept_ids"))


@query(
    "resample_state_o5",
    f"""SELECT doc_id, array_to_string(tokens[1:CASE WHEN len(tokens) = 0 THEN 0 ELSE {DOC_DRAW} % len(tokens) END], '')
        AS state FROM v_tokens""",
)
def resample_state(spark, sf):
    prefix = tokens.random_proper_prefix(F.col("tokens"), SEED, F.col("doc_id"))
    return views.words(spark, sf).select("doc_id", tokens.detokenize(prefix).alias("state"))


# ------------------------------------------------------- padding and examples

EXAMPLE = f"""SELECT doc_id,
    list_resize(ids, greatest(len(ids), {MAX_LENGTH}), {PAD_ID}) AS input_ids,
    list_resize([-100 for x in ids[1:masked]] || ids[masked + 1:], greatest(len(ids), {MAX_LENGTH}), -100) AS labels,
    list_resize([1 for x in ids], greatest(len(ids), {MAX_LENGTH}), 0) AS attention_mask,
    masked FROM v_sft_ids"""


def supervised(spark, sf):
    parts = views.supervised_parts(spark, sf)
    built = tokens.supervised_example(
        F.col("prompt_ids"), F.col("state_ids"), F.col("completion_ids"), FENCE_IDS, EOS_ID, PAD_ID, MAX_LENGTH
    )
    masked = F.size("prompt_ids") + F.size("state_ids")
    return parts.select("doc_id", masked.alias("masked"), built.alias("_built")).select("doc_id", "masked", "_built.*")


def arrays_sql(*names: str) -> str:
    return ", ".join(f"array_to_string({name}, ',') AS {name}" for name in names)


@query(
    "pad_t12",
    f"""SELECT doc_id, array_to_string(list_resize(ids, greatest(len(ids), {MAX_LENGTH}), {PAD_ID}), ',') AS ids,
        array_to_string(list_resize(ids, greatest(len(ids), {MAX_LENGTH}), -100), ',') AS labels,
        array_to_string(list_resize([1 for x in ids], greatest(len(ids), {MAX_LENGTH}), 0), ',') AS mask
        FROM v_tokens""",
)
def pad(spark, sf):
    ids = F.col("ids")
    return views.token_ids(spark, sf).select(
        "doc_id",
        join_items(tokens.right_pad(ids, PAD_ID, MAX_LENGTH)).alias("ids"),
        join_items(tokens.right_pad(ids, fixed.IGNORED_LABEL, MAX_LENGTH)).alias("labels"),
        join_items(tokens.right_pad(tokens.ones(ids), 0, MAX_LENGTH)).alias("mask"),
    )


@query("unpad_t13", "SELECT doc_id, array_to_string(ids, ',') AS ids FROM v_tokens")
def unpad(spark, sf):
    padded = tokens.right_pad(F.col("ids"), fixed.IGNORED_LABEL, MAX_LENGTH)
    return views.token_ids(spark, sf).select("doc_id", join_items(tokens.unpad(padded)).alias("ids"))


@query("ones_mask_t14", "SELECT doc_id, array_to_string([1 for x in ids], ',') AS mask FROM v_tokens")
def ones_mask(spark, sf):
    return views.token_ids(spark, sf).select("doc_id", join_items(tokens.ones(F.col("ids"))).alias("mask"))


@query(
    "supervised_example_t15",
    f"SELECT doc_id, {arrays_sql('input_ids', 'labels', 'attention_mask')} FROM examples",
    examples=EXAMPLE,
)
def supervised_example(spark, sf):
    return supervised(spark, sf).select("doc_id", *[text_of(n) for n in ("input_ids", "labels", "attention_mask")])


ANSWER_LENGTH = 512


@query(
    "answer_example_t16",
    f"""SELECT doc_id, len(ids) + 1 > {ANSWER_LENGTH} AS too_long,
        CASE WHEN len(ids) + 1 <= {ANSWER_LENGTH} THEN
             array_to_string(list_resize(ids || [{EOS_ID}], {ANSWER_LENGTH}, {PAD_ID}), ',') END AS input_ids,
        CASE WHEN len(ids) + 1 <= {ANSWER_LENGTH} THEN
             array_to_string(list_resize([-100 for x in state_ids] || ids[len(state_ids) + 1:] || [{EOS_ID}],
                             {ANSWER_LENGTH}, -100), ',') END AS labels,
        CASE WHEN len(ids) + 1 <= {ANSWER_LENGTH} THEN
             array_to_string(list_resize([1 for x in ids] || [1], {ANSWER_LENGTH}, 0), ',') END AS attention_mask
        FROM v_tokens""",
)
def answer_example(spark, sf):
    """The first third asks, the rest answers; documents that do not fit are flagged."""
    third = F.size("state_ids")
    rows = views.token_ids(spark, sf).withColumn("answer_ids", F.slice("ids", third + 1, F.size("ids")))
    built = tokens.answer_example(
        F.col("state_ids"), F.col("answer_ids"), EOS_ID, PAD_ID, ANSWER_LENGTH, strict=False
    )
    return rows.select("doc_id", built.alias("_built")).select(
        "doc_id",
        F.col("_built").isNull().alias("too_long"),
        *[text_of(f"_built.{name}", name) for name in ("input_ids", "labels", "attention_mask")],
    )


# --------------------------------------------------------------- offset labels

KEPT_IDS = """SELECT doc_id, array_to_string(list(CASE WHEN kept THEN id ELSE -100 END ORDER BY pos), ',') AS labels,
    NOT bool_or(kept) AS throwout, any_value(state_prompt) AS state_prompt,
    CASE WHEN bool_or(kept) THEN coalesce(string_agg(token, '' ORDER BY pos) FILTER (pos < first_kept), '') END AS before
    FROM v_kept GROUP BY doc_id"""


def labelled(spark, sf):
    return examples.label_by_offset(views.offset_rows(spark, sf), "ids", "tokens", "spans", "state_prompt")


@query("offset_labels_t17", "SELECT doc_id, labels FROM kept_ids", kept_ids=KEPT_IDS)
def offset_labels(spark, sf):
    return labelled(spark, sf).select("doc_id", text_of("labels"))


@query(
    "corrected_state_t18",
    r"""SELECT doc_id, throwout, CASE WHEN throwout THEN state_prompt WHEN contains(before, '```python' || chr(10))
               THEN regexp_extract(before, '(?s).*```python\n(.*)', 1) END AS state FROM kept_ids""",
    kept_ids=KEPT_IDS,
)
def corrected_state(spark, sf):
    return labelled(spark, sf).select("doc_id", "throwout", "state")


@query("drop_throwouts_f1", "SELECT doc_id, labels FROM kept_ids WHERE NOT throwout", kept_ids=KEPT_IDS)
def drop_throwouts(spark, sf):
    return examples.drop_throwouts(labelled(spark, sf)).select("doc_id", text_of("labels"))


@query(
    "with_labels_f2",
    "SELECT doc_id FROM v_kept GROUP BY doc_id HAVING count(*) FILTER (kept) > 0",
)
def with_labels(spark, sf):
    return examples.with_labels(labelled(spark, sf)).select("doc_id")


@query(
    "of_length_f3",
    f"SELECT doc_id, array_to_string(input_ids, ',') AS input_ids FROM examples WHERE len(attention_mask) = {MAX_LENGTH}",
    examples=EXAMPLE,
)
def of_length(spark, sf):
    return examples.of_length(supervised(spark, sf), length=MAX_LENGTH).select("doc_id", text_of("input_ids"))


# ---------------------------------------------------------------------- checks

@query(
    "bad_labels_q3",
    """SELECT count(*) AS checked, count(*) FILTER (
           len(list_filter(labels, lambda x: x <> -100)) = 0
           OR len([1 for x, i in labels if x <> -100 AND x <> input_ids[i]]) > 0
           OR len(list_filter(labels[1:masked], lambda x: x <> -100)) > 0) AS violations FROM examples""",
    examples=EXAMPLE,
)
def bad_labels(spark, sf):
    return quality.bad_labels(supervised(spark, sf), "masked")


@query(
    "wrong_lengths_q4",
    f"SELECT count(*) AS checked, count(*) FILTER (len(input_ids) > {MAX_LENGTH}) AS violations FROM examples",
    examples=EXAMPLE,
)
def wrong_lengths(spark, sf):
    return quality.wrong_lengths(supervised(spark, sf), "input_ids", MAX_LENGTH)


@query(
    "states_without_tokens_q5",
    "SELECT count(*) AS checked, count(*) FILTER (len(state_ids) = 0) AS violations FROM v_tokens",
)
def states_without_tokens(spark, sf):
    rows = views.token_ids(spark, sf).withColumn("padded", F.concat("state_ids", F.array(F.lit(EOS_ID))))
    return quality.states_without_tokens(rows, "padded", EOS_ID)


@query(
    "decode_mismatches_q6",
    """SELECT doc_id, array_to_string(tokens[1:len(tokens) - 1], '') AS cleaned, text AS code
       FROM v_tokens JOIN documents USING (doc_id) WHERE doc_id % 7 = 0 AND len(tokens) > 0""",
)
def decode_mismatches(spark, sf):
    """Documents that their ids do not bring back: every seventh, as it is short of its last id."""
    ids, short = F.col("ids"), F.pmod("doc_id", F.lit(7)) == 0
    rows = views.token_ids(spark, sf).select(
        "doc_id", F.when(short, head(ids, F.size(ids) - 1)).otherwise(ids).alias("ids")
    )
    decoded = decode(rows, ["doc_id"], "ids", views.vocabulary(spark, sf), own_texts=True)
    expected = views.table(spark, sf, "documents").select("doc_id", F.col("text").alias("code"))
    return quality.decode_mismatches(decoded, expected, ["doc_id"]).select("doc_id", "cleaned", "code")
