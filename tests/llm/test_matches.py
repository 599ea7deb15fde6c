"""Decontamination, components and near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest

from tests.llm.conftest import documents
from tracemill.llm import decontaminate, minhash
from tracemill.llm.components import components

LONG = "long text " * 50_000


# ----------------------------------------------------------------- benchmark

def brute_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_hits(text, items):
    words, hit, found = brute_words(text), set(), set()
    for name, item in items:
        own = brute_words(item)
        size = min(13, len(own))
        for at in range(max(1, len(own) - 12) if own else 0):
            for start in range(len(words) - size + 1):
                if words[start : start + size] == own[at : at + size]:
                    hit |= set(range(start, start + size))
                    found.add(str(name))
    n = len(words)
    return n, len(hit), sorted(found), bool(hit) and 20 * len(hit) >= n


def noisy(pick, count, words):
    return " ".join(pick.choice(words) + pick.choice(["", "", ",", "!"]) for _ in range(count))


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 400])
def test_benchmark_against_brute_force(spark_llm, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    pick = random.Random(block)
    words = ["aa", "Bb", "cc", "é", "x1", "dd", "ee", "ff"]
    items = [(i, noisy(pick, pick.choice([0, 1, 2, 5, 13, 14, 30]), words)) for i in range(25)]
    items += [(3, "zz only here"), (None, "null item words"), (90, None), (91, "...")]
    texts = [None, "", "?!", "NULL  item-words", "zz only here zz only here", LONG]
    for _ in range(30):
        item = pick.choice(items)[1] or ""
        cut = brute_words(item)[pick.randrange(3) :]
        texts.append(noisy(pick, 20, words) + " " + " ".join(cut) + " " + noisy(pick, pick.choice([0, 400]), ["q", "r"]))
    bench = spark_llm.createDataFrame(items, "item_id long, text string")
    docs = documents(spark_llm, texts, n_hit=["old"] * len(texts))
    named = [("null" if name is None else name, item) for name, item in items]
    for r in decontaminate.match_benchmark(docs, bench).collect():
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == brute_hits(texts[r["doc_id"]], named)
    assert decontaminate.match_benchmark(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.match_benchmark(docs.limit(0), bench).count() == 0
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {
        i for i, text in enumerate(texts) if not brute_hits(text, named)[3]
    }


# ---------------------------------------------------------------- components

@pytest.mark.parametrize("seed", range(2))
def test_components(spark_llm, seed):
    pick = random.Random(seed)
    edges = [(pick.randrange(60), pick.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    frame = spark_llm.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["component"] for r in components(frame).collect()}
    assert found == {x: root(x) for x in {y for a, b in edges if a != b for y in (a, b)}}


# ----------------------------------------------------------- near-duplicates

def brute_sets(text):
    words = (re.sub("[A-Z]", lambda m: m[0].lower(), text or "")).encode().split()
    if not words:
        return set()
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_components(rows):
    sets = [brute_sets(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return [least[root(i)] for i in range(len(rows))], [len(s) for s in sets]


def edited(pick, words, edits):
    out = list(words)
    for _ in range(edits):
        out[pick.randrange(len(out))] = f"e{pick.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("stars, cell", [(minhash.STAR_ROUNDS, minhash.CELL_CLASSES), (0, 5)])
def test_near_duplicates_against_brute_force(spark_llm, monkeypatch, stars, cell):
    monkeypatch.setattr(minhash, "STAR_ROUNDS", stars)
    monkeypatch.setattr(minhash, "CELL_CLASSES", cell)
    pick = random.Random(stars)
    texts = [None, "", " \n", "one two", "One TWO", "one two three", LONG, LONG + "x", "a b c d e", "A b c d e"]
    for _ in range(6):
        words = [f"w{pick.randrange(10**6)}" for _ in range(120)]
        texts += [edited(pick, words, pick.randrange(8)) for _ in range(12)]
    pick.shuffle(texts)
    docs = documents(spark_llm, texts, kept=["x"] * len(texts))
    want, sizes = brute_components(list(enumerate(texts)))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i in range(len(texts)) if want[i] == i})


def test_near_duplicates_edges(spark_llm, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", -1)
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (7, "other words"), (None, "z"), (None, "z"), (1, None)]
    docs = spark_llm.createDataFrame(rows, "doc_id long, text string")
    out = sorted(map(str, (tuple(r) for r in minhash.near_duplicates(docs).collect())))
    assert out == sorted(
        map(str, [(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (7, 1, 7, True), (None, 1, None, True), (None, 1, None, True), (1, 0, 1, True)])
    )
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_pruning_keeps_what_is_similar():
    steps = minhash.needed_matches()
    assert [n for n, _ in steps] == list(range(16, 129, 16))
    rng = np.random.default_rng(4)
    draws = (rng.random((20_000, 128)) < 0.75).cumsum(axis=1)
    lost = np.zeros(len(draws), bool)
    for n, needed in steps:
        lost |= draws[:, n - 1] < needed
    assert lost.mean() < 5e-4 and steps[-1][1] > 64


def test_signatures_estimate_similarity():
    left = minhash.shingles_of(" ".join(f"w{i}" for i in range(1000)), minhash.WordHashes())
    right = minhash.shingles_of(" ".join(f"w{i}" for i in range(200, 1200)), minhash.WordHashes())
    truth = len(np.intersect1d(left, right)) / len(np.union1d(left, right))
    close = (minhash.signature_of(left) == minhash.signature_of(right)).mean()
    assert abs(close - truth) < 0.15
