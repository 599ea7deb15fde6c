"""SimHash near-duplicates: an inverted index of fingerprint bytes with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits agree in at least 5 of
their 8 bytes. The index lists fingerprints by bytes at their positions. A list
of one byte would hold a share of 1/256 of all fingerprints and meet them in
the square of the corpus, so lists are those of four bytes at once: the 14
quadruples of a Steiner system, of which any five positions contain one. The
members of a list meet there: shared positional bytes are tallied, pairs with
five or more are retained and their bits compared.

A list is searched outwards from its members, and whoever has been reached is
not compared again, so a group of near copies costs its size and not its
square, and yields a link per member rather than one per pair. A list of many
members is first dealt out by a fifth byte; the members of such a list can
differ in 24 bits only, which bounds it, and are found by probing for values
three bits away.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import map_batches, stage
from tracemill.llm.components import components

SHINGLE = 3
SEED = 42
BITS = 64
MOST_BITS = 3
#: Bytes that a pair must share.
LEAST_SHARED = 8 - MOST_BITS
#: Members up to which a list is searched as it is; a longer one is dealt out by a fifth byte.
LIST_MEMBERS = 256
#: Members of a dealt list from which values are probed rather than compared.
PROBED_MEMBERS = 4096
CHUNK = 1 << 14
EDGES = "a long, b long"


def quadruples() -> list[tuple[int, ...]]:
    """14 quadruples of 8 positions such that any five positions contain one.

    Either half, and pairs of either half that belong to the same one of its
    three perfect matchings: three positions of a half hold a pair of each.
    """
    low, high = (0, 1, 2, 3), (4, 5, 6, 7)
    mixed = [
        (first, second, 4 + third, 4 + fourth)
        for kind in (((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2)))
        for first, second in kind
        for third, fourth in kind
    ]
    return [low, high, *mixed]


def mask_of(positions: tuple[int, ...]) -> int:
    """The bits of the bytes at these positions, as a signed 64-bit integer."""
    bits = sum(0xFF << (8 * place) for place in positions)
    return bits - (1 << 64) if bits >> 63 else bits


def fingerprint(text: str | None) -> int:
    """Majority of the bits of all shingles' hashes, repeats included; zero without words.

    Words are runs without ASCII white space, A-Z lower-cased; fewer words than
    a shingle are one shingle.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[start:end], SEED) for start, end in zip(starts, ends[size - 1 :].tolist())]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.array(hashes[at : at + CHUNK], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, fp`` of every row, the fingerprint as a signed long."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(value) for value in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values.view(np.int64), pa.int64())], names=["doc_id", "fp"]
            )

    return map_batches(narrow, measure, T.StructType([narrow.schema[0], T.StructField("fp", T.LongType())]))


def reach_by_tally(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(member, seed)`` that join the connected members (distinct unsigned fingerprints)."""
    found, seeds, left = [], [], members
    while len(left) > 1:
        seed, left = left[0], left[1:]
        frontier = np.array([seed], np.uint64)
        while len(frontier) and len(left):
            reached = np.zeros(len(left), bool)
            step = max(1, CHUNK // len(left))
            for at in range(0, len(frontier), step):
                differing = frontier[at : at + step, None] ^ left
                shared = (differing.view(np.uint8).reshape(*differing.shape, 8) == 0).sum(axis=2, dtype=np.uint8)
                retained = shared >= LEAST_SHARED
                if retained.any():
                    reached |= (retained & (np.bitwise_count(differing) <= MOST_BITS)).any(axis=0)
            frontier, left = left[reached], left[~reached]
            found.append(frontier)
            seeds.append(np.full(len(frontier), seed, np.uint64))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(found), np.concatenate(seeds)


def reach_by_probing(members: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for members that agree in the five bytes of ``mask``: at most 2^24 of them."""
    free = [place for place in range(8) if not (mask >> (8 * place)) & 0xFF]
    small = np.zeros(len(members), np.int64)
    for i, place in enumerate(free):
        small |= ((members >> np.uint64(8 * place)) & np.uint64(0xFF)).astype(np.int64) << (8 * i)
    whole = np.zeros(1 << 24, np.int32)
    whole[small] = np.arange(1, len(members) + 1)
    flips = np.array([sum(1 << b for b in bits) for k in range(1, MOST_BITS + 1) for bits in combinations(range(24), k)])
    found, seeds = [], []
    for seed in range(len(members)):
        if not whole[small[seed]]:
            continue
        whole[small[seed]] = 0
        frontier = small[seed : seed + 1]
        while len(frontier):
            following = []
            for at in range(0, len(frontier), 1024):
                near = (frontier[at : at + 1024, None] ^ flips).reshape(-1)
                near = np.unique(near[whole[near] > 0])
                places = whole[near] - 1
                whole[near] = 0
                following.append(near)
                found.append(members[places])
                seeds.append(np.full(len(places), members[seed], np.uint64))
            frontier = np.concatenate(following)
    return np.concatenate(found or [members[:0]]), np.concatenate(seeds or [members[:0]])


def links_of(members: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    if len(members) > PROBED_MEMBERS and bin(mask & (1 << 64) - 1).count("1") == 8 * LEAST_SHARED:
        return reach_by_probing(members, mask)
    return reach_by_tally(members)


def meet(lists: DataFrame) -> DataFrame:
    """Links ``a, b`` within every list (``mask, value, fp``, at least two members each)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, value, parts = 0, 0, []

        def closed() -> tuple[np.ndarray, np.ndarray]:
            return links_of(np.concatenate(parts), mask)

        for batch in batches:
            if not batch.num_rows:
                continue
            masks, values, fps = (batch.column(i).to_numpy() for i in range(3))
            fps = fps.view(np.uint64)
            cuts = np.flatnonzero((masks[1:] != masks[:-1]) | (values[1:] != values[:-1])) + 1
            out = []
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fps)]):
                if parts and (masks[start] != mask or values[start] != value):
                    out.append(closed())
                    parts = []
                mask, value = int(masks[start]), int(values[start])
                parts.append(fps[start:end])
            yield _edges(out)
        if parts:
            yield _edges([closed()])

    dealt = lists.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value")
    return dealt.mapInArrow(search, EDGES)


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ends = [np.concatenate([pair[i] for pair in found]) if found else np.empty(0, np.uint64) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(end.view(np.int64), pa.int64()) for end in ends], names=["a", "b"])


def _listed(members: DataFrame, masks: Column) -> DataFrame:
    """``mask, value, fp, n`` of the lists that hold more than one member."""
    entries = members.select("fp", F.explode(masks).alias("mask")).select(
        "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp"
    )
    sizes = entries.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
    return entries.join(sizes, ["mask", "value"])


def similar_fingerprints(classes: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints (``fp``, distinct) at most 3 bits apart."""
    quads = quadruples()
    first = stage(_listed(classes, F.array(*[F.lit(mask_of(q)) for q in quads])), "lists")
    short = meet(first.where(F.col("n") <= LIST_MEMBERS))
    long = first.where(F.col("n") > LIST_MEMBERS)
    finer = F.create_map(
        *[
            x
            for q in quads
            for x in (F.lit(mask_of(q)), F.array(*[F.lit(mask_of((*q, p))) for p in range(8) if p not in q]))
        ]
    )
    # Any five positions contain one quadruple only, so no finer list comes up twice.
    dealt = _listed(long, F.element_at(finer, F.col("mask")))
    return short.union(meet(dealt))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    ``fp`` is the text's fingerprint as a signed long; fingerprints at most 3
    bits apart are linked, and a component is named by the smallest id reachable.
    Null texts and texts without words have fingerprint zero, linked like any
    other. Null ids come last: a component of null ids alone has a null id.
    Equal rows stay, each with the same component. Other columns are not looked at.
    """
    rows = stage(fingerprints(docs, doc_id, text), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(similar_fingerprints(classes)).withColumnRenamed("node", "fp")
    placed = classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def show(fp: Column) -> Column:
    """A fingerprint as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
