"""Packing: tokens as the tokenizer gives them, each in one piece, windows full."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import FOLDER, documents
from tracemill.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


def awkward(seed):
    pick = random.Random(seed)
    parts = ["word", " ", "  ", "\n", "\n\n", "\t", "é", " ", " ", "'s", "12", "!?", "\r\n", "<|endoftext|>", "\x85", "\x1c", "あ", "😀", " x"]
    return ["".join(pick.choice(parts) for _ in range(pick.randrange(1, 25))) for _ in range(1500)]


def test_pieces_keep_the_tokens(tokenizer):
    texts = [*awkward(1), "", " ", "  a", "a  ", "a \nb c"]
    found = packing.Encoder(packing.byte_bpe_path()).encode(texts)
    for text, content in zip(texts, found):
        assert np.frombuffer(content, np.uint16).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def check(rows, want):
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(want)
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in pieces]).tolist()
        assert ids == want[doc] and pieces[0]["doc_tokens"] == len(want[doc])
        assert [r["start"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces]])[:-1].tolist()
    short = 0
    for pieces in by_window.values():
        pieces.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in pieces])
        assert [r["offset"] for r in pieces] == [0, *ends[:-1].tolist()] and ends[-1] <= packing.WINDOW
        short += ends[-1] < packing.WINDOW
    return short


def test_pack_documents(spark_llm, tokenizer):
    docs = spark_llm.read.parquet(f"{FOLDER}/documents.parquet")
    want = {
        r["doc_id"]: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0]
        for r in docs.select("doc_id", "text").collect()
    }
    pieces = packing.pack(docs)
    assert check(pieces.collect(), want) <= max(8, pieces.rdd.getNumPartitions())


@pytest.mark.parametrize("shard", [3, packing.SHARD_DOCS])
def test_pack_awkward(spark_llm, tokenizer, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_DOCS", shard)
    texts = [None, "", "a", "same text " * 30, "same text " * 30, "long one " * 3000, *awkward(2)[:40], None]
    docs = documents(spark_llm, texts, ids=["x"] * len(texts)).repartition(2)
    want = {i: [*(tokenizer.encode(t or "", add_special_tokens=False).ids), 0] for i, t in enumerate(texts)}
    check(packing.pack(docs).collect(), want)
    assert packing.pack(docs.limit(0)).count() == 0


def test_neighbours_share_a_window():
    rng = np.random.default_rng(0)
    topics = [np.arange(100 * t, 100 * t + 100) for t in range(1, 5)]
    shard = packing.Shard()
    for i in range(40):
        shard.add(i, np.append(rng.choice(topics[i % 4], 255), 0).astype(np.uint16))
    statistics = packing.Statistics(np.ones(600), 255.0)
    rows = []
    packing.pack_shard(shard, statistics, lambda *row: rows.append(row))
    windows = {}
    for window, _, document, _, _ in rows:
        windows.setdefault(window, set()).add(document % 4)
    assert sum(len(topics) == 1 for topics in windows.values()) >= 8


def test_like_documents_share_a_window_wherever_they_stand(spark_llm, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 16)
    rng = np.random.default_rng(4)
    groups = [" ".join(f"{''.join(rng.choice(list('abcdefghijklmnop'), 7))}" for _ in range(60)) for _ in range(24)]
    # The four copies of a text stand far apart: one in each quarter of the table.
    texts = [f"{text} {turn}" for turn in range(4) for text in groups]
    windows = {}
    for r in packing.pack(documents(spark_llm, texts).repartition(4, "doc_id")).collect():
        windows.setdefault(r["doc_id"], set()).add(r["sequence_id"])
    shared = [
        bool(windows[i] & windows[j])
        for i in range(len(texts))
        for j in range(i)
        if i % 24 == j % 24
    ]
    assert sum(shared) >= 0.75 * len(shared)
