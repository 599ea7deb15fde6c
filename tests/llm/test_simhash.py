"""SimHash near-duplicates against brute force over all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import FOLDER, documents
from tracemill.llm import simhash
from tracemill.llm.queries_matches import simhash_bytes


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i : i + size]).encode(), 42).intdigest() for i in range(len(words) - size + 1)]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 3:
            parent[root(j)] = root(i)
    return [root(i) for i in range(len(prints))]


def brute(rows):
    prints = [brute_fingerprint(text) for _, text in rows]
    roots, least = brute_components(prints), {}
    for (doc, _), root in zip(rows, roots):
        if doc is not None:
            least[root] = min(least.get(root, doc), doc)
    return sorted(
        (str(doc), f"{fp:016x}", str(least.get(root))) for (doc, _), fp, root in zip(rows, prints, roots)
    )


def shown(frame):
    out = frame.select("doc_id", simhash.show(frame["fp"]).alias("f"), "component_id").collect()
    return sorted((str(a), b, str(c)) for a, b, c in out)


def test_quadruples_cover_all_fives():
    quads = [set(q) for q in simhash.quadruples()]
    assert all(sum(q <= set(five) for q in quads) == 1 for five in combinations(range(8), 5))


@pytest.mark.parametrize("members, probed", [(256, 4096), (4, 4096), (4, 5)])
def test_against_brute_force(spark_llm, monkeypatch, members, probed):
    monkeypatch.setattr(simhash, "LIST_MEMBERS", members)
    monkeypatch.setattr(simhash, "PROBED_MEMBERS", probed)
    pick = random.Random(12)
    texts = [None, "", " \n\t", "one", "One  two", "é É x", "long text " * 50_000, "long text " * 50_000 + "x"]
    for _ in range(4):
        words = [f"w{pick.randrange(10**6)}" for _ in range(400)]
        for _ in range(40):
            own = list(words)
            for _ in range(pick.randrange(6)):
                own[pick.randrange(len(own))] = f"E{pick.randrange(10**6)}"
            texts.append(" ".join(own))
    rows = list(enumerate(texts)) + [(None, "one"), (None, "alone here"), (None, "alone here"), (3, "one"), (3, "one")]
    pick.shuffle(rows)
    docs = spark_llm.createDataFrame([(*row, 5, "x") for row in rows], "doc_id long, text string, fp int, value string")
    want = brute(rows)
    assert shown(simhash.near_duplicates(docs)) == want
    # Near copies do link: the rule is put to work.
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_nothing_alike(spark_llm):
    docs = documents(spark_llm, ["one two three four", "other words are here"])
    assert [tuple(r)[0::2] for r in simhash.near_duplicates(docs).orderBy("doc_id").collect()] == [(0, 0), (1, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_searches_agree_with_all_pairs(seed):
    rng = np.random.default_rng(seed)
    mask = simhash.mask_of((0, 2, 3, 5, 7))
    fixed = rng.integers(1 << 63, dtype=np.uint64) & np.uint64(mask & (1 << 64) - 1)
    centres = rng.integers(1 << 63, size=4, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.integers(0, 64, 6)) for _ in range(300)], dtype=np.uint64)
    members = np.unique(((centres[rng.integers(0, 4, 300)] ^ flips) & ~np.uint64(mask & (1 << 64) - 1)) | fixed)
    want = brute_components([int(m) for m in members])
    for links in (simhash.reach_by_tally(members), simhash.reach_by_probing(members, mask)):
        place = {int(m): i for i, m in enumerate(members)}
        seeds = {place[int(a)]: place[int(b)] for a, b in zip(*links)}
        assert len(seeds) == len(members) - len(set(want))
        got = [seeds.get(i, i) for i in range(len(members))]
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i, j in combinations(range(len(members)), 2))


def test_query(spark_llm):
    rows = [tuple(r) for r in spark_llm.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((str(a), b, str(c)) for a, b, c in simhash_bytes(spark_llm, FOLDER).collect())
    assert got == brute(rows)
