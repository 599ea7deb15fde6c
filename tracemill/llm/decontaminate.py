"""Removal of benchmark passages by a prefix-filtered join of word windows.

A window is ``WINDOW`` consecutive words of an item, or all of a shorter item.
A document can only hold a window if it holds the window's rarest shingle, so
documents look up their shingles among those prefixes alone; offsets that leave
the document are dropped, and what remains is compared word by word.

The benchmark is the query set. It is handled in blocks of bounded size, each a
pass over all documents, which needs no shuffle of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemill.llm.common import map_batches

WINDOW = 13
SHINGLE = 3
#: Benchmark text that one pass handles, on average; a block is broadcast.
BLOCK_BYTES = 4 << 20
#: A document is contaminated when at least one word in so many is hit.
ONE_IN = 20
CHUNK = 65_536

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(
    b if b in _KEPT or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, ASCII lower-cased; every non-ASCII character is part of a word."""
    return text.encode().translate(_TABLE).split() if text else []


def shingle_keys(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key for every run of ``size`` word ids."""
    count = max(0, len(ids) - size + 1)
    keys = np.full(count, size, np.uint64)
    values = ids.astype(np.uint64)
    for place in range(size):
        keys = (keys ^ values[place : place + count]) * _STEP
        keys ^= keys >> np.uint64(29)
    return keys


@dataclass
class Block:
    """Windows of some items, and for every shingle size the shingles in them."""

    vocabulary: dict[bytes, int]
    names: list[str]
    windows: np.ndarray  # word ids, padded with -2
    lengths: np.ndarray
    owners: list[list[int]]  # items by window
    shingles: dict[int, np.ndarray]  # sorted distinct keys by size
    prefixes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(word, -1) for word in words], np.int64)


def build_block(items: list[tuple[str, str | None]]) -> Block:
    vocabulary: dict[bytes, int] = {}
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    owners: dict[tuple[int, ...], set[int]] = {}
    for name, text in items:
        ids = [vocabulary.setdefault(word, len(vocabulary)) for word in words_of(text)]
        for at in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
            owners.setdefault(tuple(ids[at : at + WINDOW]), set()).add(number[name])
    windows = np.full((len(owners), WINDOW), -2, np.int64)
    for i, window in enumerate(owners):
        windows[i, : len(window)] = window
    lengths = (windows >= 0).sum(axis=1)
    shingles = {}
    for size in range(1, SHINGLE + 1):
        mine = [shingle_keys(w[:n], size) for w, n in zip(windows, lengths) if min(n, SHINGLE) == size]
        if mine:
            shingles[size] = np.unique(np.concatenate(mine))
    return Block(vocabulary, names, windows, lengths, [sorted(o) for o in owners.values()], shingles, {})


def choose_prefixes(block: Block, counts: dict[int, np.ndarray]) -> None:
    """Give every window its rarest shingle (ties: the lesser key), with its offset."""
    for size, known in block.shingles.items():
        which = [i for i, n in enumerate(block.lengths) if min(n, SHINGLE) == size]
        found = []
        for i in which:
            keys = shingle_keys(block.windows[i, : block.lengths[i]], size)
            rarity = counts[size][np.searchsorted(known, keys)]
            offset = int(np.lexsort((keys, rarity))[0])
            found.append((int(keys[offset]), i, offset))
        found.sort()
        keys, first = np.unique(np.array([k for k, _, _ in found], np.uint64), return_index=True)
        ends = np.append(first[1:], len(found))
        block.prefixes[size] = (
            keys,
            np.stack([first, ends]),
            np.array([i for _, i, _ in found], np.int64),
            np.array([o for _, _, o in found], np.int64),
        )


def _lookup(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``keys`` that are known, and which known key each is."""
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    where = np.flatnonzero(known[at] == keys)
    return where, at[where]


def count_shingles(docs: DataFrame, block: Block, text: str) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        totals = {size: np.zeros(len(keys), np.int64) for size, keys in block.shingles.items()}
        for batch in batches:
            for value in batch.column(0):
                ids = block.ids(words_of(value.as_py()))
                for size, known in block.shingles.items():
                    _, which = _lookup(known, shingle_keys(ids, size))
                    totals[size] += np.bincount(which, minlength=len(known))
        for size, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), size, np.int32)), pa.array(seen), pa.array(total[seen])],
                names=["size", "which", "times"],
            )

    rows = map_batches(docs.select(text), count, "size int, which long, times long")
    totals = {size: np.zeros(len(keys), np.int64) for size, keys in block.shingles.items()}
    # One row per shingle of the block at most.
    for row in rows.groupBy("size", "which").agg(F.sum("times").alias("times")).collect():
        totals[row["size"]][row["which"]] = row["times"]
    return totals


def find_windows(block: Block, ids: np.ndarray) -> tuple[np.ndarray, set[int]]:
    """Edges of hit words (+1 at a start, -1 past an end), and the items found."""
    edges = np.zeros(len(ids) + 1, np.int64)
    items: set[int] = set()
    columns = np.arange(WINDOW)
    for size, (keys, spans, windows, offsets) in block.prefixes.items():
        where, which = _lookup(keys, shingle_keys(ids, size))
        sizes = spans[1, which] - spans[0, which]
        for at in range(0, len(where), CHUNK // 8):
            piece = slice(at, at + CHUNK // 8)
            repeat = sizes[piece]
            total = int(repeat.sum())
            inner = np.arange(total) - np.repeat(np.cumsum(repeat) - repeat, repeat)
            entry = np.repeat(spans[0, which[piece]], repeat) + inner
            window = windows[entry]
            start = np.repeat(where[piece], repeat) - offsets[entry]
            fits = (start >= 0) & (start + block.lengths[window] <= len(ids))
            window, start = window[fits], start[fits]
            place = np.minimum(start[:, None] + columns, len(ids) - 1)
            wanted = block.windows[window]
            same = ((ids[place] == wanted) | (wanted == -2)).all(axis=1)
            window, start = window[same], start[same]
            np.add.at(edges, start, 1)
            np.add.at(edges, start + block.lengths[window], -1)
            for i in np.unique(window):
                items.update(block.owners[i])
    return edges, items


def blocks_of(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Block]:
    """The benchmark in blocks by hash of the item; a null id is the id ``null``."""
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("name"), F.col(text).alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = size // BLOCK_BYTES + 1
    for number in range(count):
        mine = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(count)) == number)
        yield build_block([(r["name"], r["text"]) for r in mine.collect()])


def match_benchmark(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``n_items``, ``items`` and ``contaminated`` to every row.

    ``n_hit`` counts the words inside any occurrence of a window, ``items``
    holds the ids with occurring windows as sorted strings. Null and empty
    texts have no words; items without words match nothing; equal item ids are
    one item. Columns of these names in the input are replaced.
    """
    made = ("n_words", "n_hit", "n_items", "items", "contaminated")
    rest = docs.drop(*made, "_edges", "_items")
    kept = rest.columns
    rows = rest.withColumns({"_edges": F.lit(None).cast("binary"), "_items": F.array().cast("array<string>")})
    for block in blocks_of(benchmark, item_id, item_text):
        if not len(block.windows):
            continue
        choose_prefixes(block, count_shingles(rest, block, text))
        rows = _mark(rows, block, kept.index(text))
    words = _finish(rows, kept.index(text))
    return words.withColumns(
        {
            "n_items": F.size("items").cast("long"),
            "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("n_words")),
        }
    )


def _mark(rows: DataFrame, block: Block, position: int) -> DataFrame:
    """Merge the block's hits into ``_edges`` and ``_items``, the last two columns."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            all_edges, all_items = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for i, value in enumerate(batch.column(position)):
                words = words_of(value.as_py())
                if not words:
                    continue
                edges, items = find_windows(block, block.ids(words))
                if items:
                    if all_edges[i] is not None:
                        edges += np.frombuffer(all_edges[i], np.int64)
                    all_edges[i] = edges.tobytes()
                    all_items[i] = sorted({*all_items[i], *(block.names[x] for x in items)})
            columns = [
                *batch.columns[:-2],
                pa.array(all_edges, batch.schema.field(batch.num_columns - 2).type),
                pa.array(all_items, batch.schema.field(batch.num_columns - 1).type),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_batches(rows, mark, rows.schema)


def _finish(rows: DataFrame, position: int) -> DataFrame:
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(words_of(value.as_py())) for value in batch.column(position)]
            hits = [
                0 if edges is None else int((np.cumsum(np.frombuffer(edges, np.int64)) > 0).sum())
                for edges in batch.column(batch.num_columns - 2).to_pylist()
            ]
            columns = [*batch.columns[:-2], pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), batch.column(batch.num_columns - 1)]
            fields = [
                *list(batch.schema)[:-2],
                pa.field("n_words", pa.int64()),
                pa.field("n_hit", pa.int64()),
                pa.field("items", batch.schema.field(batch.num_columns - 1).type),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    schema = StructType(
        [*rows.schema.fields[:-2], *StructType.fromDDL("n_words long, n_hit long, items array<string>")]
    )
    return map_batches(rows, finish, schema)


def items_digest(items: list[str]) -> str:
    """Hex SHA-256 of comma-joined ids; the same as ``sha2`` over ``array_join``."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, in their own columns."""
    marked = match_benchmark(docs, benchmark)
    return marked.where(~F.col("contaminated")).select(*[F.col(f"`{name}`") for name in docs.columns])
