"""The conversation trie against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import FOLDER, sf_of
from tests.test_queries import TABLES, normal
from tracemill.llm import sketch, trie
from tracemill.llm.queries_trie import OP11_SQL, prefix_trie
from tracemill.operators import scale

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [turn[2:] for turn in sorted(turns)] for conv, turns in own.items()}
    whole = {}
    for conv, turns in own.items():
        head = zlib.crc32(str(conv).encode()) % 9
        base = conv - (abs(conv) % 5) * (1 if conv >= 0 else -1)
        whole[conv] = own.get(base, [])[:head] + turns[head:]
    members = defaultdict(list)
    for conv, turns in sorted(whole.items()):
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(conv)
    out = []
    for node, convs in members.items():
        under = [other for other in members if other[: len(node)] == node]
        has_child = {other[:-1] for other in members if other}
        ends = [conv for conv in convs if len(whole[conv]) == len(node)]
        out.append(
            (
                convs[0],
                len(node),
                members[node[:-1]][0] if node else None,
                len(convs),
                sum(len(other) == len(node) + 1 for other in under),
                sum(other not in has_child for other in under),
                sum((len(members[other]) - 1) * len(other[-1][1].encode()) for other in under if other),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def awkward_rows(seed):
    pick = random.Random(seed)
    rows = []
    for conv in [*range(-12, 60), 10**15, 10**15 + 1]:
        for turn in range(pick.choice([1, 3, 9, 14])):
            rows.append((conv, turn, pick.choice(["user", "é", None]), pick.choice(["a", "b", "", None, "ü" * 30])))
    # Copies of whole conversations, ties, repeated rows, null turns, a conversation gone but for its children.
    rows += [(100 + 5 * i, turn, "user", f"same {turn}") for i in range(40) for turn in range(12)]
    rows += [(7, 3, "user", "tie"), (7, 3, "user", "tie"), (8, None, None, None), (8, None, "z", "first"), (9, 1, "u", "x" * 200_000)]
    rows = [row for row in rows if row[0] != 20] + [(None, 0, "user", "lost"), (None, None, None, None)]
    pick.shuffle(rows)
    return rows


def run(spark, rows, tmp_path):
    frame = spark.createDataFrame([(*row, 1, "x") for row in rows], SCHEMA + ", depth int, px string")
    folder = sf_of(spark, tmp_path / "data", conversations=frame)
    return sorted((tuple(r) for r in prefix_trie(spark, folder).collect()), key=repr)


@pytest.mark.parametrize("seed, cells", [(1, sketch.LEAST_CELLS), (2, 64)])
def test_against_brute_force(spark_llm, monkeypatch, tmp_path, seed, cells):
    """Also with a sketch so small that it clears few prefixes, and pieces of a few characters."""
    monkeypatch.setattr(sketch, "LEAST_CELLS", cells)
    monkeypatch.setattr(sketch, "MAX_CELLS", max(cells, 64))
    monkeypatch.setattr(trie, "CHUNK_CHARS", cells)
    rows = awkward_rows(seed)
    assert run(spark_llm, rows, tmp_path) == brute(rows)


def test_long_conversations_by_blocks(spark_llm, monkeypatch, tmp_path):
    defaults = tuple(8 if value == scale.BLOCK else value for value in scale.with_running.__defaults__)
    monkeypatch.setattr(scale.with_running, "__defaults__", defaults)
    rows = [(conv, turn, "user", f"turn {turn}" if turn < 60 else f"{conv} {turn}") for conv in (0, 5, 10) for turn in range(90)]
    assert run(spark_llm, rows, tmp_path) == brute(rows)


def test_no_conversations(spark_llm, tmp_path):
    assert run(spark_llm, [], tmp_path) == []
    assert run(spark_llm, [(None, 1, "user", "x")], tmp_path / "null") == []


def test_screen_leaves_few_prefixes_to_shuffle(spark_llm):
    turns = spark_llm.range(3000).select(
        F.col("id").alias("conv_id"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("depth"),
        F.lit(4).cast("long").alias("length"),
        F.lit("user").alias("role"),
    )
    turns = turns.withColumn("text", F.when(F.col("depth") == 1, "hello").otherwise(F.concat("conv_id", F.lit(" "), "depth")))
    rows = trie.prefixes(turns).cache()
    screen = sketch.Screen(rows, trie.NODE, by_row=True)
    maybe = rows.where(screen.may_repeat(*[F.col(name) for name in trie.NODE]))
    assert maybe.where("depth = 1").count() == 3000 and maybe.where("depth > 1").count() < 600
    rows.unpersist()


def test_query_matches_sql(spark_llm):
    duck = duckdb.connect()
    for name in TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    frame, cursor = prefix_trie(spark_llm, FOLDER), duck.execute(OP11_SQL)
    assert normal(frame.columns, frame.collect()) == normal([c[0] for c in cursor.description], cursor.fetchall())
