"""Queries that judge or rewrite one document at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import language, pii, quality
from tracemill.llm.registry import query, table


@query("op1_language_id")
def language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learned from the folds that are not held out."""
    docs = table(spark, sf, "documents").select(
        "doc_id", "text", "lang", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2).alias("held_out")
    )
    docs = docs.withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    dictionaries = language.learn_dictionaries(docs.where(~F.col("held_out")).drop("held_out"))
    found = language.predict_language(docs.select("doc_id", "held_out", "text"), dictionaries)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), tokens AS (
  SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM d
), windows AS (
  SELECT doc_id, pos, array_to_string(list_slice(words, pos, pos + 7), ' ') AS w FROM tokens WHERE pos + 7 <= len(words)
), twice AS (
  SELECT doc_id, w FROM windows GROUP BY doc_id, w HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT windows.doc_id, unnest(range(pos, pos + 8)) AS p FROM windows JOIN twice USING (doc_id, w)
  ) GROUP BY doc_id
), lines AS (
  SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
base AS (
  SELECT d.doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id)
), failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS k FROM failed GROUP BY source),
fit AS (SELECT sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) ** 2 AS v FROM hosts),
prior AS (
  SELECT m, CASE WHEN v > 1e-12 THEN least(greatest(m * (1 - m) / v - 1, 1), 1000000) ELSE 1000000 END AS s FROM fit
), rates AS (SELECT source, (k + m * s) / (n + s) AS r, n + s + 1 AS w FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (r - 2 * sqrt(r * (1 - r) / w) > 0.5) AS kept
FROM failed JOIN rates ON failed.source IS NOT DISTINCT FROM rates.source
"""


@query("op4_host_rules", OP4_SQL)
def host_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rule figures of every document, and whether it and its host pass."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    judged = quality.judge(quality.with_signals(docs).drop("text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op8_contextual_pii")
def contextual_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data of every document: base spans, and those found by learned contexts."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pii.find_personal_data(docs).select(
        "doc_id",
        *[f"n_{kind}" for kind in pii.KINDS],
        F.sha2(pii.show_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.show_spans(F.col("spans")).alias("spans"),
    )
