"""Packing documents into training windows next to what resembles them.

Texts become token ids once and are staged. Documents are ordered by the terms
they share, so that like ones come together wherever they stood in the input. A
shard is a run of that order up to a size; it holds a BM25 inverted index of its documents, weighted with document
frequencies of the whole corpus. Documents longer than a window fill windows of
their own; what is left of a document seeds a window, which its nearest unused
neighbours fill, cut where the window ends.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import map_batches, stage

WINDOW = 1024
END = 0
#: A shard ends at so many documents or tokens left over, whichever comes first.
SHARD_DOCS = 4096
SHARD_TOKENS = 2_000_000
#: Terms that name a document's place in the order, one after another; rare terms are likelier picks.
PLACE_TERMS = 4
#: A table has so many partitions at most; beyond, a partition holds more shards.
MAX_PARTITIONS = 8192
K1, B = 1.2, 0.75
CACHE = 600_000
PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)
_SPACE_RUN = re.compile(r"\s ")
_BOUNDARY = re.compile(r"(?<=\S)(?= )")


def byte_bpe_path() -> str:
    """The ranks of the byte-level BPE whose ids ``byte_bpe_50k.json`` gives."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces_of(text: str) -> list[str]:
    """Cut a text before spaces that follow a non-space.

    The tokenizer's own words start there, so the tokens of the pieces are
    those of the text.
    """
    if _SPACE_RUN.search(text):
        return _BOUNDARY.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + word for word in rest]]


class Encoder:
    """Token ids of texts, with the ids of recent pieces at hand."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.size = len(ranks)
        self.bpe = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [pieces_of(text) if text else [] for text in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache, encode, kind = self.cache, self.bpe.encode_ordinary, self.kind
        for piece in {piece for pieces in split for piece in pieces}.difference(cache):
            cache[piece] = np.array(encode(piece), kind).tobytes()
        return [b"".join([cache[piece] for piece in pieces]) for pieces in split]


def tokenize(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: the tokens of every text as unsigned integers, without the end token."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            ids = encoder.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(narrow, encode, "doc_id long, ids binary")


def term_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order, and how often each occurs."""
    if not len(ids):
        return ids, np.empty(0, np.int64)
    ordered = np.sort(ids, kind="stable")
    edges = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    return ordered[np.append(0, edges)], np.diff(np.concatenate([[0], edges, [len(ids)]]))


@dataclass
class Statistics:
    """Of all documents: how many hold each token, and their mean length."""

    weights: np.ndarray
    mean_length: float
    docs: int = 0
    tokens: int = 0


def corpus_statistics(tokens: DataFrame, kind: np.dtype, size: int) -> Statistics:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding = np.zeros(size + 2, np.int64)
        for batch in batches:
            for content in batch.column(0).to_pylist():
                ids = np.frombuffer(content, kind)
                holding[term_counts(ids)[0]] += 1
                holding[size] += 1
                holding[size + 1] += len(ids)
        seen = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(holding[seen])], names=["term", "docs"])

    rows = map_batches(tokens.select("ids"), count, "term long, docs long")
    holding = np.zeros(size + 2, np.int64)
    # One row per token of the vocabulary at most.
    for row in rows.groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        holding[row["term"]] = row["docs"]
    docs, total = int(holding[size]), int(holding[size + 1])
    weights = np.log1p((docs - holding[:size] + 0.5) / (holding[:size] + 0.5))
    return Statistics(weights, max(1.0, total / max(1, docs)), docs, total + docs)


def place_ranks(weights: np.ndarray) -> np.ndarray:
    """A rank of every term for each of ``PLACE_TERMS`` picks.

    Two documents pick the same least term with the chance of their likeness,
    the weight of the terms they share over that of all their terms.
    """
    drawn = np.random.default_rng(10).random((PLACE_TERMS, len(weights)))
    return -np.log1p(-drawn) / np.maximum(weights, 1e-9)


def place_of(ids: np.ndarray, ranks: np.ndarray) -> bytes:
    """The terms a document picks, as a key that sorts by the first, then the next; empty without terms."""
    terms = term_counts(ids)[0]
    return terms[ranks[:, terms].argmin(axis=1)].astype(">u4").tobytes() if len(terms) else b""


def in_order(tokens: DataFrame, statistics: Statistics, kind: np.dtype) -> DataFrame:
    """``doc_id, ids`` in the order of likeness, range partitioned: like documents share a shard at any size.

    A place held by many documents is cut by their row numbers, so none is
    too much for a task.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(place_ranks(statistics.weights))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [place_of(np.frombuffer(ids, kind), shared.value) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(places, pa.binary())], names=["doc_id", "ids", "row", "place"]
            )

    shards = max(statistics.docs / SHARD_DOCS, statistics.tokens / SHARD_TOKENS)
    parts = int(min(max(shards, 1), MAX_PARTITIONS))
    placed = map_batches(tokens, place, "doc_id long, ids binary, row long, place binary")
    return placed.repartitionByRange(parts, "place", "row").sortWithinPartitions("place", "row").select("doc_id", "ids")


@dataclass
class Shard:
    """Documents waiting to be packed, what is left of each, and their index."""

    ids: list[np.ndarray] = field(default_factory=list)
    names: list[int | None] = field(default_factory=list)
    tokens: int = 0

    def add(self, name: int | None, ids: np.ndarray) -> None:
        self.names.append(name)
        self.ids.append(ids)
        self.tokens += len(ids)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.tokens >= SHARD_TOKENS

    def index(self, statistics: Statistics) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Postings by term (bounds, documents, scores), and every document's terms."""
        counted = [term_counts(ids[:-1]) for ids in self.ids]
        sizes = np.array([len(terms) for terms, _ in counted])
        owners = np.repeat(np.arange(len(counted)), sizes)
        terms = np.concatenate([terms for terms, _ in counted]).astype(np.int64)
        times = np.concatenate([times for _, times in counted]).astype(np.float64)
        lengths = np.array([len(ids) - 1 for ids in self.ids], np.float64)
        longer = K1 * (1 - B + B * lengths / statistics.mean_length)
        scores = statistics.weights[terms] * times * (K1 + 1) / (times + longer[owners])
        queries = np.split(terms, np.cumsum(sizes)[:-1])
        order = np.argsort(terms, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(statistics.weights)))])
        return bounds, owners[order], scores[order], queries


def pack_shard(shard: Shard, statistics: Statistics, emit: Callable[..., None]) -> int:
    """Fill windows from the shard's documents; returns how many. ``emit(window, offset, document, start, length)``."""
    if not shard.ids:
        return 0
    bounds, owners, scores, queries = shard.index(statistics)
    lengths = np.array([len(ids) for ids in shard.ids])
    # Documents longer than a window have had their windows; the rest waits.
    used = (lengths // WINDOW) * WINDOW
    window = 0
    for document in range(len(lengths)):
        for at in range(0, used[document], WINDOW):
            emit(window, 0, document, at, WINDOW)
            window += 1
    waiting = used < lengths
    following = 0
    for seed in range(len(lengths)):
        if not waiting[seed]:
            continue
        filled = int(lengths[seed] - used[seed])
        emit(window, 0, seed, int(used[seed]), filled)
        waiting[seed] = False
        near: list[int] = []
        if filled < WINDOW and len(queries[seed]):
            spans = [slice(bounds[term], bounds[term + 1]) for term in queries[seed]]
            found = np.bincount(
                np.concatenate([owners[s] for s in spans]),
                np.concatenate([scores[s] for s in spans]),
                minlength=len(lengths),
            )
            found[~waiting] = 0
            near = [int(x) for x in np.argsort(-found, kind="stable")[: WINDOW] if found[x] > 0]
        ranked = iter(near)
        while filled < WINDOW:
            other = next((x for x in ranked if waiting[x]), None)
            if other is None:  # nothing resembles the seed: the next that waits
                following = max(following, seed + 1)
                while following < len(lengths) and not waiting[following]:
                    following += 1
                if following == len(lengths):
                    break
                other = following
            take = min(WINDOW - filled, int(lengths[other] - used[other]))
            emit(window, filled, other, int(used[other]), take)
            used[other] += take
            filled += take
            waiting[other] = used[other] < lengths[other]
        window += 1
    return window


def pack(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents in windows of ``WINDOW`` tokens: the columns of ``PIECES``.

    A document is the tokens of its whole text and the end token; null is an
    empty text. Every token lies in one piece. ``ids`` are the piece's tokens as
    little-endian unsigned 32-bit integers, ``start`` the document's tokens
    before it, ``offset`` the window's. Only the last window of a shard can be
    short. Repeated rows are packed as often as they occur; other columns play
    no part. A repeated task reads the same staged tokens and packs them alike.
    """
    path = path or byte_bpe_path()
    encoder = Encoder(path)
    kind, size = np.dtype(encoder.kind), encoder.size
    numbered = tokenize(docs, path, doc_id, text).withColumn("row", F.monotonically_increasing_id())
    tokens = stage(numbered, "tokens")
    measured = corpus_statistics(tokens, kind, size)
    shared = docs.sparkSession.sparkContext.broadcast(measured)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        statistics = shared.value
        first = TaskContext.get().partitionId() << 33
        shard, done = Shard(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal shard, done
            rows: list[tuple] = []

            def emit(window: int, offset: int, document: int, start: int, length: int) -> None:
                ids = shard.ids[document][start : start + length].astype("<u4").tobytes()
                rows.append(
                    (shard.names[document], start, length, ids, len(shard.ids[document]), first + done + window, offset)
                )

            done += pack_shard(shard, statistics, emit)
            for at in range(0, len(rows), 2048):
                columns = zip(*rows[at : at + 2048])
                kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
                names = [part.split()[0] for part in PIECES.split(",")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
            shard = Shard()

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard.add(name, np.append(np.frombuffer(content, kind), kind.type(END)))
                if shard.full():
                    yield from flush()
        yield from flush()

    return map_batches(in_order(tokens, measured, kind), fill, PIECES)
