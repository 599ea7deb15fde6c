"""Language, shards, chat, quality and url rules on small and awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import FOLDER, documents, sf_of
from tracemill.llm import chat, language, quality, queries_rows, queries_text, sharding, urls

LONG = "word " * 200_000


# ------------------------------------------------------------------ language

def test_language_held_out(spark_llm):
    rows = queries_text.language_id(spark_llm, FOLDER).join(
        spark_llm.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id"
    )
    held = rows.where("held_out").collect()
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_edges(spark_llm):
    train = documents(
        spark_llm,
        ["the cat sat on the mat and the dog ran", "le chat est sur la table et le chien", None, "x"],
        lang=["en", "fr", "en", None],
    )
    dictionaries = language.learn_dictionaries(train)
    assert sorted(dictionaries) == ["en", "fr"]
    asked = documents(spark_llm, ["the cat and the dog", "", None, "12 + 34", LONG], lang_pred=["a"] * 5)
    found = language.predict_language(asked, dictionaries).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in found[:4]] == ["en", "und", "und", "und"]
    assert found[4]["lang_pred"] in dictionaries
    nothing = language.learn_dictionaries(train.where("lang is null"))
    assert nothing == {}
    assert {r["lang_pred"] for r in language.predict_language(asked, nothing).collect()} == {"und"}
    assert language.predict_language(asked.limit(0), dictionaries).count() == 0


# -------------------------------------------------------------------- shards

def check_shards(rows, shards):
    sizes = [0] * shards
    for shard in range(shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
        sizes[shard] = len(slots)
    assert max(sizes) - min(sizes) <= 1


def test_shards_query(spark_llm):
    rows = queries_rows.hypergeometric_shards(spark_llm, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(
        r["doc_id"] for r in spark_llm.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()
    )
    check_shards(rows, queries_rows.SHARDS)


@pytest.mark.parametrize("texts", [["same"] * 50, [], [None, "", "a", LONG], ["x"]])
def test_shards_edges(spark_llm, texts):
    frame = documents(spark_llm, texts).withColumns({"shard": F.lit("mine"), "_metadata": F.lit(1)})
    out = sharding.shuffle_into_shards(frame, 3)
    assert out.columns == ["doc_id", "text", "_metadata", "shard", "slot"]
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    check_shards(rows, 3)


def test_shards_of_a_filtered_scan(spark_llm):
    frame = spark_llm.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id % 3 = 1")
    rows = sharding.shuffle_into_shards(frame, 7).select("doc_id", "shard", "slot").collect()
    assert len(rows) == frame.count()
    check_shards(rows, 7)


def test_matrix_is_a_split_of_the_shards():
    starts, shard_rows = np.array([0, 5, 5, 12, 30]), np.array([10, 10, 10])
    rows = [sharding.matrix_row(starts, shard_rows, 4, part) for part in range(4)]
    counts = np.array([r[0] for r in rows])
    assert counts.sum(axis=1).tolist() == [5, 0, 7, 18] and counts.sum(axis=0).tolist() == [10, 10, 10]
    assert np.array_equal(np.array([r[1] for r in rows]), np.cumsum(counts, axis=0) - counts)


def test_draws_follow_the_hypergeometric_law(monkeypatch):
    expected = 40 * 30 / 100
    for limit in (sharding.NUMPY_LIMIT, 0):
        monkeypatch.setattr(sharding, "NUMPY_LIMIT", limit)
        rng = np.random.default_rng(1)
        found = np.array([sharding.hypergeometric(rng, 30, 70, 40) for _ in range(4000)])
        assert abs(found.mean() - expected) < 0.2
        assert abs(found.var() - 40 * 0.3 * 0.7 * 60 / 99) < 0.5
    big = sharding.hypergeometric(np.random.default_rng(2), 3 * 10**9, 7 * 10**9, 10**6)
    assert abs(big - 300_000) < 5_000


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000])
def test_permutation(size):
    out = sharding.permute(np.arange(size), size, sharding._keys(1, 2, size))
    assert sorted(out) == list(range(size))


# ---------------------------------------------------------------------- chat

def test_chat_round_trip(spark_llm):
    rows = {r["conv_id"]: r for r in queries_rows.reply_trees(spark_llm, FOLDER).collect()}
    given = spark_llm.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    probe = "</s>[INST] ok [/INST]"
    turns = {-1: [(0, "user", probe), (1, "assistant", probe)]}
    for r in given:
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    assert set(rows) == set(turns)
    for conv, said in turns.items():
        said.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in said)
        learnt = "".join(text for _, role, text in said if role == "assistant")
        row = rows[conv]
        assert row["n_turns"] == len(said)
        assert row["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def tree(spark, rows):
    return spark.createDataFrame(rows, "t string, n string, p string, role string, text string, score double")


def test_best_branch_of_a_tree(spark_llm):
    rows = [
        ("a", "1", None, "user", "q", 0.0),
        ("a", "2", "1", "assistant", "poor", 1.0),
        ("a", "3", "1", "assistant", "good", 5.0),
        ("a", "4", "3", "user", "thanks", None),
        ("a", "4", "3", "user", "thanks", None),
        ("b", "9", "missing", None, None, 0.0),
        (None, None, None, "assistant", "\\[INST]<s>", 0.0),
    ]
    out = chat.format_conversations(tree(spark_llm, rows), "t", "n", "p", score="score")
    turns = {
        (r["tree"], r["leaf"]): [(x["role"], x["text"]) for x in r["turns"]]
        for r in out.withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    }
    assert turns == {
        ("a", "4"): [("user", "q"), ("assistant", "good"), ("user", "thanks")],
        ("b", "9"): [("", "")],
        (None, None): [("assistant", "\\[INST]<s>")],
    }
    both = chat.format_conversations(tree(spark_llm, rows), "t", "n", "p", score="score", branches=None)
    assert sorted(r["leaf"] for r in both.where("tree = 'a'").collect()) == ["2", "4"]
    assert chat.format_conversations(tree(spark_llm, []), "t", "n", "p").count() == 0


def test_deep_chain_and_cycle(spark_llm):
    chain = [("a", str(i), str(i - 1) if i else None, "assistant", f"m{i}", 0.0) for i in range(45)]
    out = chat.format_conversations(tree(spark_llm, chain), "t", "n", "p").select(
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    assert out.first()["loss"] == "".join(f"m{i}" for i in range(45))
    with pytest.raises(ValueError):
        chat.format_conversations(tree(spark_llm, [("a", "1", "2", "", "", 0.0), ("a", "2", "1", "", "", 0.0)]), "t", "n", "p")


def test_escape_is_reversible(spark_llm):
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "x\n", "/s>", "é😀"]
    pick = random.Random(3)
    texts = ["".join(pick.choice(parts) for _ in range(6)) for _ in range(300)]
    frame = documents(spark_llm, texts).withColumn("e", chat.escape(F.col("text")))
    for r in frame.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r["u"] == r["text"]
        assert not any(mark in r["e"] for mark in ("<s>", "</s>", "[INST]", "[/INST]"))


# ------------------------------------------------------------------- quality

def brute_signals(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit)


def test_signals_against_brute_force():
    pick = random.Random(5)
    words = ["a", "b", "é\u00a0x", "#c|", "d"]
    texts = [None, "", " \n\t", "a\na\n\na \r\n"]
    texts += ["".join(pick.choice(words) + pick.choice(" \n\t") for _ in range(pick.randrange(60))) for _ in range(200)]
    for text in texts:
        assert quality.signals_of(text) == brute_signals(text)


def test_signals_survive_equal_codes(monkeypatch):
    monkeypatch.setattr(quality, "_WEIGHTS", np.zeros(8, np.uint64))
    words = [b"%d" % (i % 11) for i in range(60)]
    assert quality.repeated_words(words) == brute_signals(" ".join(w.decode() for w in words))[4]


def test_bad_host_takes_its_documents(spark_llm):
    fine = " ".join(f"w{i}" for i in range(40))
    texts = ["short"] * 60 + [fine] * 3 + [fine] * 60 + [None]
    hosts = ["bad"] * 63 + ["good"] * 60 + [None]
    frame = documents(spark_llm, texts, source=hosts, kept=["x"] * len(texts))
    judged = quality.judge(quality.with_signals(frame)).collect()
    assert len(judged) == len(texts)
    assert {(r["source"], r["kept"]) for r in judged} == {("bad", False), ("good", True), (None, False)}
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns and kept.count() == 60
    assert quality.keep_good(frame.limit(0)).count() == 0


# ---------------------------------------------------------------------- urls

def test_urls(spark_llm):
    given = [
        None,
        "no scheme",
        "http://",
        "HTTP://WWW.Example.COM/en/x?q=/fr/#a",
        "x://blog.example.com/en/#a",
        "x://com/EN/",
        "x://a.net/es/1",
        "x://a.net?/es/",
        "x://spam.org/a",
        "x://spam.org/a",
        "x://fresh.org/b",
        "x://é..com/" + "a" * 100_000,
    ]
    bad = [None] * 8 + [True] * 2 + [None] * 2
    rows = [(i, u, b) for i, (u, b) in enumerate(zip(given, bad))] + [(100 + i, "x://spam.org/", True) for i in range(50)]
    rows += [(200 + i, f"x://h{i % 5}.org/", False) for i in range(100)]
    pages = spark_llm.createDataFrame(rows, "page_id long, url string, bad boolean").withColumn("host", F.lit("?"))
    rules = spark_llm.createDataFrame(queries_rows.URL_RULES, "rule_host string, rule_path string, rule_verdict string")
    out = {r["page_id"]: r for r in urls.judge_urls(pages, rules).collect()}
    assert len(out) == len(rows)
    assert [out[i]["host"] for i in range(4)] == ["", "", "", "www.example.com"]
    assert out[3]["path"] == "/en/x" and out[7]["path"] == ""
    assert [out[i]["rule"] for i in range(9)] == [
        None, None, None, "www.example.com/en/", "example.com/en/", "com/", "net/es/", None, None,
    ]
    assert out[4]["verdict"] == "block" and out[5]["verdict"] == "allow"
    assert out[8]["verdict"] == "block" and out[10]["verdict"] == "allow" and out[200]["verdict"] == "allow"
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert urls.judge_urls(pages, rules.limit(0)).where("rule is not null").count() == 0


def test_op5_without_labels(spark_llm, tmp_path):
    pages = spark_llm.createDataFrame([(1, "x://a.b/c")], "page_id long, url string")
    labels = spark_llm.createDataFrame([], "doc_id long, quality int, toxic int")
    folder = sf_of(spark_llm, tmp_path / "sf", pages=pages, labels=labels)
    assert queries_rows.host_reputation(spark_llm, folder).first()["verdict"] == "allow"
