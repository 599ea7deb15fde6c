"""Queries that match documents with each other or with the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import decontaminate, lines, minhash, simhash
from tracemill.llm.registry import query, table

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), items AS (
  SELECT DISTINCT item_id, least(len(words), 13) AS n, array_to_string(list_slice(words, pos, pos + least(len(words), 13) - 1), ' ') AS w
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 11, 2))) AS pos FROM b WHERE len(words) > 0)
), places AS (
  SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM d
), found AS (
  SELECT doc_id, pos, n, item_id FROM (
    SELECT doc_id, pos, n, array_to_string(list_slice(words, pos, pos + n - 1), ' ') AS w
    FROM places, (SELECT DISTINCT n FROM items) WHERE pos + n - 1 <= len(words)
  ) JOIN items USING (n, w)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS p FROM found) GROUP BY doc_id
), owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN owners USING (doc_id)
"""


@query("op7_benchmark_windows", OP7_SQL)
def benchmark_windows(spark: SparkSession, sf: str) -> DataFrame:
    """How much of every document lies in windows of the benchmark."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    items = table(spark, sf, "benchmark").select("item_id", "text")
    return decontaminate.match_benchmark(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, pos, pos + least(len(words), 5) - 1), ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 3, 2))) AS pos FROM d WHERE len(words) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common.n >= 75 * (p.n + q.n - common.n)
), sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT b, root FROM reach JOIN sides ON a = node
), least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, d.doc_id = root AS kept
FROM d JOIN least ON node = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""


@query("op9_minhash_bayes", OP9_SQL)
def minhash_bayes(spark: SparkSession, sf: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return minhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


@query("op6_fuzzy_lines")
def fuzzy_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the lines, short ones too, that like lines elsewhere make superfluous."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lines.drop_repeated_lines(docs, min_words=1).select("doc_id", "n_lines", "n_removed", "text")


@query("op12_simhash_bytes")
def simhash_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """The fingerprint of every document, and the component of like fingerprints it is in."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", simhash.show(F.col("fp")).alias("fingerprint"), "component_id")
