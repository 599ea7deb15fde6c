"""The query that audits filters in every order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import audit
from tracemill.llm.registry import query, table

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT doc_id, part, (len(words) < 50)::INT + 2 * (100 * list_unique(words) < 65 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask
), letters(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
steps AS (
  SELECT o, s::INT AS step, sum(bit) FILTER (instr(o, name) < s) AS before, sum(bit) FILTER (instr(o, name) = s) AS own
  FROM (
    SELECT p.name || q.name || r.name || s.name || t.name AS o
    FROM letters p, letters q, letters r, letters s, letters t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31
      AND len(list_distinct([p.bit, q.bit, r.bit, s.bit, t.bit])) = 5
  ), range(1, 6) AS x(s), letters GROUP BY o, s
), steps2 AS (SELECT o, step, coalesce(before, 0)::INT AS before, own::INT AS own FROM steps)
SELECT part, o AS filter_order, step,
  coalesce(sum(n) FILTER (mask & (before | own) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & own <> 0), 0)::BIGINT AS shapley
FROM c, steps2 GROUP BY part, o, step
"""


@query("op13_filter_interactions", OP13_SQL)
def filter_interactions(spark: SparkSession, sf: str) -> DataFrame:
    """What five filters remove, in every order and for every source."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return audit.audit_filters(docs, labels)
