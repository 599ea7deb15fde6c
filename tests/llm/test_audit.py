"""The filter audit against a plain application of every order."""

import itertools
import random
import re

import duckdb

from tests.llm.conftest import FOLDER
from tests.test_queries import TABLES, normal
from tracemill.llm import audit, sketch
from tracemill.llm.queries_audit import OP13_SQL, filter_interactions


def brute_fails(rows):
    out = []
    for doc, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ""
        fails += "A" * (len(words) < 50)
        fails += "B" * (100 * len(set(words)) < 65 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        fails += "D" * bool(re.search("[#$%&*|]", text))
        twins = [other for other, body, _ in rows if (body or "") == text and other is not None]
        fails += "E" * (doc is not None and any(other < doc for other in twins))
        out.append(fails)
    return out


def brute(rows, good, toxic):
    fails, table = brute_fails(rows), {}
    for part in {source or "" for _, _, source in rows}:
        mine = [(doc, f) for (doc, _, source), f in zip(rows, fails) if (source or "") == part]
        lost = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                removed = [(doc, f) for doc, f in left if letter in f]
                redundant = sum(letter in f for _, f in mine) - len(removed)
                left = [(doc, f) for doc, f in left if letter not in f]
                lost[letter] += len(removed)
                table[part, "".join(order), step] = [
                    len(left),
                    len(removed),
                    redundant,
                    sum(f == letter for _, f in mine),
                    sum(doc in good for doc, _ in removed),
                    sum(doc in toxic for doc, _ in removed),
                ]
        for (own, order, step), figures in table.items():
            if own == part:
                figures.append(lost[order[step - 1]])
    return table


def test_against_brute_force(spark_llm):
    pick = random.Random(13)
    words = ["alpha", "Beta", "GAMMA", "delta$", "e", "f#", "été", "x y", "zz\t"]
    texts = [" ".join(pick.choice(words[: pick.choice([2, 5, 9])]) for _ in range(pick.choice([0, 3, 60, 200]))) for _ in range(40)]
    texts += [None, "", "  \n", "long text " * 40_000, "ÀB" * 30]
    rows = [(pick.randrange(60), pick.choice(texts), pick.choice(["a", "b", None, ""])) for _ in range(150)]
    rows += [(None, "twin", "a"), (None, "twin", "a"), (5, "twin", "a"), (5, "twin", "a"), (4, "twin", None)]
    labels = [(i, pick.choice([0, 1, None]), pick.choice([0, 1, None])) for i in range(0, 70, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark_llm.createDataFrame(
        [(*row, "mine", 1, 2) for row in rows], "doc_id long, text string, source string, part string, mask int, x long"
    )
    marks = spark_llm.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    want = brute(rows, good, toxic)
    out = audit.audit_filters(docs, marks)
    got = {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in out.collect()}
    assert got == want
    letters = {row: "".join(x for i, x in enumerate("ABCDE") if row >> i & 1) for row in range(32)}
    masks = audit.document_masks(docs)
    assert sorted((str(r["doc_id"]), letters[r["mask"]]) for r in masks.collect()) == sorted(
        (str(doc), fails) for (doc, _, _), fails in zip(rows, brute_fails(rows))
    )
    assert audit.audit_filters(docs.limit(0), marks).count() == 0
    assert audit.audit_filters(docs, marks.limit(0)).where("good_lost > 0 OR toxic_lost > 0").count() == 0


def test_a_full_sketch_changes_nothing(spark_llm, monkeypatch):
    """With far too few cells nothing is proven unique, and the exact count still decides."""
    docs = spark_llm.createDataFrame([(i, f"text {i % 700}", "s") for i in range(1000)], "doc_id long, text string, source string")
    want = sorted(map(tuple, audit.document_masks(docs).collect()))
    assert sum(mask >= 16 for _, _, mask in want) == 300
    monkeypatch.setattr(sketch, "LEAST_CELLS", 64)
    monkeypatch.setattr(sketch, "MAX_CELLS", 64)
    assert sorted(map(tuple, audit.document_masks(docs).collect())) == want


def test_screen_clears_only_what_is_unique(spark_llm, monkeypatch):
    monkeypatch.setattr(sketch, "CHUNK_CELLS", 1 << 10)
    items = spark_llm.range(4000).selectExpr("CASE WHEN id < 1000 THEN id % 10 ELSE id END AS x", "id AS row")
    for by_row in (False, True):
        screen = sketch.Screen(items, ["x"], by_row)
        from pyspark.sql import functions as F

        asked = items.withColumn("maybe", screen.may_repeat(F.col("x"))).collect()
        assert all(r["maybe"] for r in asked if r["row"] < 1000)
        assert sum(r["maybe"] for r in asked if r["row"] >= 1000) < 400
        assert sketch.Screen(items.limit(0), ["x"], by_row).width == sketch.LEAST_CELLS


def test_query_matches_sql(spark_llm):
    duck = duckdb.connect()
    for name in TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    frame, cursor = filter_interactions(spark_llm, FOLDER), duck.execute(OP13_SQL)
    assert normal(frame.columns, frame.collect()) == normal([c[0] for c in cursor.description], cursor.fetchall())
