"""The query that builds the trie of conversation prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import trie
from tracemill.llm.registry import query, table

OP11_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT c, n, c - c % 5 AS base, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
    ), 4294967295) % 9 AS h
  FROM (SELECT c, count(*) AS n FROM t GROUP BY c)
), r AS (
  SELECT k.c, pos + 1 AS depth, role, text FROM k JOIN t ON t.c = k.base AND pos < h
  UNION ALL
  SELECT k.c, least(k.h, coalesce(b.n, 0)) + pos - k.h + 1, role, text
  FROM k JOIN t ON t.c = k.c LEFT JOIN k b ON b.c = k.base WHERE pos >= k.h
), p AS (
  SELECT c, depth, strlen(text) AS bytes,
    string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY depth ROWS UNBOUNDED PRECEDING) AS key FROM r
  UNION ALL SELECT c, 0, 0, '' FROM k
), ends AS (SELECT c, max(depth) AS len FROM p GROUP BY c),
nodes AS (
  SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS w,
    (count(*) FILTER (depth < len) = 0)::INT AS leaf,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = len), '')) AS ends_sha256,
    substr(key, 1, greatest(length(key) - 64, 0)) AS parent
  FROM p JOIN ends USING (c) GROUP BY key, depth
), kids AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
sums AS (
  SELECT substr(key, 1, 64 * d) AS key, sum(w) AS saved_tokens, sum(leaf) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM nodes) GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, CASE WHEN n.depth > 0 THEN u.conv_id END AS parent_conv_id, n.n_convs,
  coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
  n.ends_sha256
FROM nodes n JOIN nodes u ON u.key = n.parent LEFT JOIN kids ON kids.key = n.key JOIN sums ON sums.key = n.key
"""


@query("op11_prefix_trie", OP11_SQL)
def prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """The trie of all conversations, each given the first turns of its group's first."""
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    turns = trie.number_turns(given, "conv_id", "turn", "role", "text")
    conv = F.col("conv_id")
    rebuilt, convs = trie.borrow_heads(turns, conv - conv % 5, F.crc32(conv.cast("string")) % 9)
    return trie.prefix_trie(rebuilt, convs)
