"""Queries over all rows of a table: shards, conversations, urls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm import chat, sharding, urls
from tracemill.llm.registry import query, table

SHARDS = 40
SHARD_SEED = 20_240
ROW_OVERHEAD = 16


@query("op2_hypergeometric_shards")
def hypergeometric_shards(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in 40 shards whose row counts differ by one at most."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    content = F.coalesce("text", F.lit(""))
    return sharding.shuffle_into_shards(docs, SHARDS, SHARD_SEED).select(
        "doc_id",
        (F.octet_length(content).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op3_reply_trees")
def reply_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation formatted as the one branch of its tree, and read back."""
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = given.unionByName(probe).withColumn("node", F.row_number().over(order))
    messages = numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    lines = F.transform(
        F.col("turns"), lambda turn: F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n"))
    )
    return (
        chat.format_conversations(messages, "conv_id", "node", "parent")
        .select("tree", "formatted", turns.alias("turns"), loss.alias("loss"))
        .select(
            F.col("tree").cast("long").alias("conv_id"),
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


#: The rules of the query: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

OP5_SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT page_id, h || rules.p AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY length(h || rules.p) DESC, h || rules.p) AS place
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(p.path, rules.p)
), marks AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), parts AS (
  SELECT host, string_split(host, '.') AS l, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad
  FROM p LEFT JOIN marks ON page_id = doc_id GROUP BY host
), hosts AS (
  SELECT host, array_to_string(list_slice(l, greatest(len(l) - 1, 1), len(l)), '.') AS domain, l[-1] AS suffix, n, bad FROM parts
), overall AS (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0 END AS m FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM hosts, overall GROUP BY suffix),
w0 AS (SELECT sum(n * m * (1 - m)) AS w, sum(n * (CASE WHEN n > 0 THEN bad / n ELSE 0 END - m) ** 2) AS b FROM s0),
k0 AS (SELECT CASE WHEN b > 1e-12 THEN least(greatest(w / b - 1, 1), 10000) ELSE 10000 END AS s FROM w0),
s1 AS (SELECT suffix, (bad + m * s) / (n + s) AS rate FROM s0, k0),
d0 AS (
  SELECT domain, hosts.suffix, sum(n) AS n, sum(bad) AS bad, any_value(rate) AS m
  FROM hosts JOIN s1 USING (suffix) GROUP BY domain, hosts.suffix
),
w1 AS (SELECT sum(n * m * (1 - m)) AS w, sum(n * (CASE WHEN n > 0 THEN bad / n ELSE 0 END - m) ** 2) AS b FROM d0),
k1 AS (SELECT CASE WHEN b > 1e-12 THEN least(greatest(w / b - 1, 1), 10000) ELSE 10000 END AS s FROM w1),
d1 AS (SELECT domain, (bad + m * s) / (n + s) AS rate FROM d0, k1),
h0 AS (SELECT host, n, bad, rate AS m FROM hosts JOIN d1 USING (domain)),
w2 AS (SELECT sum(n * m * (1 - m)) AS w, sum(n * (CASE WHEN n > 0 THEN bad / n ELSE 0 END - m) ** 2) AS b FROM h0),
k2 AS (SELECT CASE WHEN b > 1e-12 THEN least(greatest(w / b - 1, 1), 10000) ELSE 10000 END AS s FROM w2),
h1 AS (SELECT host, n, s, (bad + m * s) / (n + s) AS rate FROM h0, k2),
h2 AS (SELECT host, n, rate, greatest(0, rate - 2 * sqrt(rate * (1 - rate) / (n + s + 1))) AS low FROM h1)
SELECT p.page_id, p.host, p.path, rule, coalesce(v, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  n::BIGINT AS host_pages, round(rate, 6) AS host_rate, round(low, 6) AS host_low
FROM p LEFT JOIN (SELECT * FROM fits WHERE place = 1) AS fits USING (page_id) LEFT JOIN h2 ON p.host = h2.host
"""


@query("op5_host_reputation", OP5_SQL)
def host_reputation(spark: SparkSession, sf: str) -> DataFrame:
    """A verdict on every page's url."""
    marks = table(spark, sf, "labels").groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad")
    )
    pages = table(spark, sf, "pages").select("page_id", "url")
    labelled = pages.join(marks, pages["page_id"] == marks["doc_id"], "left").drop("doc_id")
    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, rule_verdict string")
    return urls.judge_urls(labelled, rules).select(
        "page_id",
        "host",
        "path",
        "rule",
        "verdict",
        "host_pages",
        F.round("host_rate", 6).alias("host_rate"),
        F.round("host_low", 6).alias("host_low"),
    )
