"""Personal data: base patterns, and contexts learned from what they find.

The values that base patterns find are seeds, all of them and whole. The two
words before a value are its lexical context; contexts and values form a graph
that is scored in rounds: a context is as good as the values it introduces, a
value as the best context it follows. Good contexts then mark identifiers no
base pattern knows. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.arrays import bind, scan
from tracemill.llm.common import stage

KINDS = ("email", "ip", "card", "phone")
#: A code point that stands for a joint inside an address or number; texts that hold it get another.
JOINT, OTHER = "\uf8ff", "\uf8fe"
#: Stands for every code point of a base value where candidates and contexts are sought.
MASK = "\uf8fd"
_NUMBER = r"[+(]*+[0-9][0-9().+-]*+"
_SIGN = r"[0-9@]|[A-Za-z0-9][._:(\[{][A-Za-z0-9]"
_AT, _DOT = r"[(\[{]?(?i:at)[)\]}]?", r"[(\[{]?(?i:dot)[)\]}]?"
#: What may be an identifier outside base values: numbers in groups, a spelled-out
#: address, or a word with a digit, an at sign or a joint between letters.
CANDIDATE = (
    rf"(?<!\S)(?:{_NUMBER}(?!\S)(?: {_NUMBER}(?!\S))*+(?: {_NUMBER}[,;:!?\"'>\]}}]++(?!\S))?"
    rf"|[A-Za-z0-9._%+-]++ {_AT} [A-Za-z0-9.-]++(?: {_DOT} [A-Za-z0-9-]++)++(?!\S)"
    rf"|[A-Za-z0-9._%+-]++ [(\[{{](?i:at)[)\]}}] [A-Za-z0-9.-]++(?!\S)"
    rf"|(?=[^\s{MASK}]*?(?:{_SIGN}))[^\s{MASK}]++(?!\S))"
)
MAY_HOLD = rf"{_SIGN}|\s{_AT}\s"
ROUNDS = 3
#: Values a context must introduce before it weighs half.
SMOOTHING = 2.0
MIN_CONFIDENCE = 0.6
MAX_WORD = 40
SPAN = "struct<start: int, end: int, value: string>"


def find_all(text: Column, original: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value) in code points.

    The pieces between matches and the matches give the places. ``text`` is
    searched; ``value`` is cut from ``original``, which has equal length.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece))
    lengths = F.transform(found, lambda value: F.length(value))
    # Each match ends where the pieces and matches up to it end.
    steps = F.zip_with(F.slice(pieces, 1, F.size(lengths)), lengths, lambda gap, own: gap + own)
    ends = scan(steps, F.lit(0), lambda total, step: total + step, "int")
    return F.zip_with(
        ends,
        lengths,
        lambda end, own: F.struct(
            (end - own).alias("start"), end.alias("end"), F.substr(original, end - own + 1, own).alias("value")
        ),
    )


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def emails(text: Column) -> Column:
    # Dots between label characters become joints, so a domain is one run and needs no nested repeat.
    local, label = rf"[A-Za-z0-9._%+{JOINT}-]", "[A-Za-z0-9-]"
    jointed = F.regexp_replace(F.translate(text, JOINT, OTHER), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", JOINT)
    pattern = rf"(?:\G|(?<!{local})){local}++@{label}++{JOINT}[A-Za-z0-9{JOINT}-]*+"
    return F.when(F.contains(text, F.lit("@")), find_all(jointed, text, pattern)).otherwise(_none())


def ips(text: Column) -> Column:
    pattern = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    small = lambda span: F.rlike(span["value"], F.lit(rf"^{part}\.{part}\.{part}\.{part}$"))
    found = F.filter(find_all(text, text, pattern), small)
    return F.when(F.rlike(text, F.lit(r"[0-9]\.[0-9]")), found).otherwise(_none())


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Digits from the right: every second one doubled, its digits summed; the sum ends in 0."""

    def worth(i: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(
        F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda total, i: total + worth(i)
    )
    return total % 10 == 0


def cards(text: Column) -> Column:
    # A space or hyphen between digits becomes a joint, so a number is one run.
    jointed = F.regexp_replace(F.translate(text, JOINT, OTHER), r"(?<=[0-9])[ -](?=[0-9])", JOINT)
    pattern = rf"[0-9][0-9{JOINT}]++"
    long_enough = lambda span: F.length(digits_of(span["value"])).between(12, 19)
    valid = lambda span: passes_luhn(digits_of(span["value"]))
    found = F.filter(F.filter(find_all(jointed, text, pattern), long_enough), valid)
    return F.when(F.rlike(text, F.lit("[0-9](?:[ -]?[0-9]){11}")), found).otherwise(_none())


def phones(text: Column) -> Column:
    pattern = r"\+[0-9][ ().0-9-]+[0-9]"
    right = lambda span: F.length(digits_of(span["value"])).between(9, 15)
    found = F.filter(find_all(text, text, pattern), right)
    return F.when(F.rlike(text, F.lit(r"\+[0-9]")), found).otherwise(_none())


def masked(text: Column, base: Column) -> Column:
    """The text with every code point of its base values (sorted (start, kind, end)) as ``MASK``."""
    ends = F.transform(base, lambda span: span["end"])
    reached = scan(ends, F.lit(0), lambda most, end: F.greatest(most, end), "int")

    def piece(span: Column, at: Column, plain: Column) -> Column:
        gap = F.greatest(span["start"] - at, F.lit(0))
        own = F.greatest(span["end"] - F.greatest(span["start"], at), F.lit(0))
        return F.concat(F.substr(plain, at + 1, gap), F.repeat(F.lit(MASK), own))

    def cover(plain: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(reached, 1, F.size(base) - 1))
        pieces = F.zip_with(base, before, lambda span, at: piece(span, at, plain))
        return F.concat(F.array_join(pieces, ""), F.substr(plain, F.array_max(ends) + 1))

    plain = F.translate(text, MASK, OTHER)
    return F.when(F.size(base) > 0, bind(plain, cover)).otherwise(plain)


def context_at(hidden: Column, start: Column) -> Column:
    """The last two words before a place, lower-cased with digits as 0; null without two.

    ``hidden`` is the masked text: a base value counts as one word, whatever it is.
    """
    span = 4 * MAX_WORD + 10
    before = F.substr(hidden, F.greatest(start - span, F.lit(0)) + 1, F.least(start, F.lit(span)))
    tail = F.regexp_replace(before, f"{MASK}++", MASK)
    words = F.regexp_extract(tail, rf"(?:^|\s)(\S{{1,{MAX_WORD}}}\s+\S{{1,{MAX_WORD}}})\s+$", 1)
    plain = F.lower(F.regexp_replace(F.regexp_replace(words, "[0-9]", "0"), r"\s+", " "))
    return F.when(plain != "", plain)


def occurrences_of(text: Column, hidden: Column, base: Column) -> Column:
    """Base values, whole and with their ``kind``, then candidates outside them, as (start, end, value, context, kind)."""
    seeds = F.transform(
        base,
        lambda span: F.struct(
            span["start"].alias("start"),
            span["end"].alias("end"),
            F.substr(text, span["start"] + 1, span["end"] - span["start"]).alias("value"),
            context_at(hidden, span["start"]).alias("context"),
            span["kind"].alias("kind"),
        ),
    )
    more = F.transform(
        find_all(hidden, text, CANDIDATE),
        lambda span: F.struct(
            span["start"].alias("start"),
            span["end"].alias("end"),
            span["value"].alias("value"),
            context_at(hidden, span["start"]).alias("context"),
            F.lit(None).cast("int").alias("kind"),
        ),
    )
    return F.when(F.rlike(hidden, F.lit(MAY_HOLD)), F.concat(seeds, more)).otherwise(seeds)


def _of_kind(kind: int, spans: Column) -> Column:
    return F.transform(
        spans,
        lambda span: F.struct(
            span["start"].alias("start"), F.lit(kind).alias("kind"), span["end"].alias("end")
        ),
    )


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Add ``base`` (sorted (start, kind, end)), ``n_email`` and so on, and ``occurrences``."""
    content = F.coalesce(F.col(text), F.lit(""))
    found = df.withColumns(
        {
            f"_{kind}": find(content)
            for kind, find in zip(KINDS, (emails, ips, cards, phones))
        }
    )
    merged = F.concat(*[_of_kind(i, F.col(f"_{kind}")) for i, kind in enumerate(KINDS)])
    return (
        found.withColumns(
            {"base": F.sort_array(merged)} | {f"n_{kind}": F.size(f"_{kind}").cast("long") for kind in KINDS}
        )
        .withColumn("_hidden", masked(content, F.col("base")))
        .withColumn("occurrences", occurrences_of(content, F.col("_hidden"), F.col("base")))
        .drop("_hidden", *[f"_{kind}" for kind in KINDS])
    )


def score_contexts(occurrences: DataFrame) -> DataFrame:
    """``context, kind, confidence`` of the contexts that introduce one kind well enough.

    ``occurrences`` has ``context``, ``value`` and ``kind``, null where no base
    pattern found the value. Counts are of distinct pairs, so a context copied
    a thousand times weighs no more.
    """
    edges = stage(
        occurrences.where(F.col("context").isNotNull())
        .groupBy("context", "value")
        .agg(*[F.max(F.coalesce(F.col("kind") == i, F.lit(False)).cast("double")).alias(f"s{i}") for i in range(len(KINDS))]),
        "edges",
    )
    scores = [F.col(f"s{i}") for i in range(len(KINDS))]
    seeds = edges.groupBy("value").agg(*[F.max(score).alias(f"s{i}") for i, score in enumerate(scores)])
    values = seeds
    contexts = None
    for turn in range(ROUNDS):
        linked = edges.select("context", "value").join(values, "value")
        contexts = linked.groupBy("context").agg(
            *[(F.sum(score) / (F.count("*") + SMOOTHING)).alias(f"p{i}") for i, score in enumerate(scores)]
        )
        if turn == ROUNDS - 1:
            break
        best = edges.select("context", "value").join(contexts, "context").groupBy("value").agg(
            *[F.max(f"p{i}").alias(f"p{i}") for i in range(len(KINDS))]
        )
        values = stage(
            seeds.join(best, "value").select(
                "value", *[F.greatest(score, F.col(f"p{i}")).alias(f"s{i}") for i, score in enumerate(scores)]
            ),
            "values",
        )
    kinds = F.array(*[F.struct(F.col(f"p{i}").alias("confidence"), F.lit(-i).alias("order")) for i in range(len(KINDS))])
    best_kind = F.array_max(kinds)
    return contexts.select(
        "context", (-best_kind["order"]).alias("kind"), best_kind["confidence"].alias("confidence")
    ).where(F.col("confidence") >= MIN_CONFIDENCE)


def show_spans(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    shown = F.transform(
        spans,
        lambda span: F.concat_ws(
            ":", F.element_at(names, span["kind"] + 1), span["start"].cast("string"), span["end"].cast("string")
        ),
    )
    return F.array_join(shown, ",")


def find_personal_data(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base, spans`` for every row; null is an empty text.

    ``base`` and ``spans`` are arrays of (start, kind, end) in code points, the
    end exclusive, sorted; kinds count in the order of ``KINDS``. ``spans``
    holds the base spans and the identifiers found by context, which overlap no
    base span. The texts are read once; what follows works on base values and candidates.
    """
    rows = df.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text")
    )
    read = stage(base_spans(rows, "_text").drop("_text"), "base")
    occurrences = read.select("doc_id", "_hash", F.explode("occurrences").alias("o")).select("doc_id", "_hash", "o.*")
    contexts = score_contexts(occurrences)
    found = (
        occurrences.where(F.col("kind").isNull())
        .drop("kind")
        .join(contexts.select("context", "kind"), "context")
        .groupBy("doc_id", "_hash")
        .agg(F.collect_set(F.struct("start", "kind", "end")).alias("_found"))
        .withColumnsRenamed({"doc_id": "_doc", "_hash": "_mine"})
    )
    joined = read.drop("occurrences").join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_mine")), "left")
    more = F.when(F.col("_found").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "_found")))
    return joined.select("doc_id", *[f"n_{kind}" for kind in KINDS], "base", more.alias("spans"))
