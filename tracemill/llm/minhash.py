"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

Documents with one shingle set form a class, and only classes are compared.
Classes that share a band are candidates. Their signatures are compared in
batches; a candidate is dropped once the posterior chance of a high enough
similarity falls under the miss probability, and survivors are verified on
their full shingle sets.

A bucket's classes are not compared in pairs: all meet its first class, and
what that links is one component from then on. Only classes of a bucket that
are still in different components meet again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import map_batches, stage
from tracemill.llm.components import components

SHINGLE = 5
PERCENT = 75
#: Bands of rows: at a similarity of 0.75 all bands miss with a chance of 5e-6.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signature places compared at once, and the chance of dropping a true pair at each step.
BATCH = 16
MISS = 1e-6
#: Rounds in which a bucket's classes meet one class, before those left meet each other.
STAR_ROUNDS = 1
#: Classes, and bytes of their sets, in one side of a cell in which those left meet.
CELL_CLASSES = 1024
CELL_BYTES = 16 << 20
#: A list of ids up to this size is broadcast; a longer one is joined by shuffle.
BROADCAST_IDS = 2_000_000
WORD_CACHE = 500_000
SETS = "doc_id long, n_shingles long, set binary, signature binary, x long, y long"
CHUNK = 1024

_rng = np.random.default_rng(9)
_MULTIPLY = _rng.integers(1 << 62, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1 << 63, size=HASHES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles_of(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are runs without ASCII white space, ASCII lower-cased. Fewer words
    than a shingle are one shingle; none are none.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    size = min(SHINGLE, len(words))
    values = np.array([hashes[word] for word in words], np.uint64)
    count = len(words) - size + 1
    keys = np.full(count, size, np.uint64)
    for place in range(size):
        keys = (keys ^ values[place : place + count]) * _STEP
        keys ^= keys >> np.uint64(32)
    return np.unique(keys)


def signature_of(shingles: np.ndarray) -> np.ndarray:
    """The least of each hash function over a set that is not empty, as 32-bit values."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        values = np.multiply.outer(shingles[at : at + CHUNK], _MULTIPLY)
        values += _ADD
        np.minimum(least, values.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def needed_matches(miss: float = MISS) -> list[tuple[int, int]]:
    """For every batch: places compared so far, and the matches a pair must have by then.

    With a uniform prior, after m matches in n places the chance that the
    similarity reaches the threshold is P(Binomial(n + 1, threshold) <= m).
    """
    threshold, out = PERCENT / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def most_differing_bits(miss: float = MISS) -> int:
    """Differing low bits of ``HASHES`` places beyond which a pair is dropped.

    Low bits agree with chance p = (1 + similarity) / 2; with a uniform prior
    the posterior after m agreements is compared like the matches above.
    """

    def tail(m: int, p: float) -> float:
        return sum(math.comb(HASHES + 1, k) * p**k * (1 - p) ** (HASHES + 1 - k) for k in range(m + 1))

    threshold = (1 + PERCENT / 100) / 2
    return max(d for d in range(HASHES + 1) if tail(HASHES - d, threshold) >= miss * tail(HASHES - d, 0.5))


def may_match(left: str, right: str) -> Column:
    """Whether two classes (``{left}n, {left}x, {left}y`` and so on) may be similar enough, by size and low bits."""
    sizes = F.least(f"{left}n", f"{right}n") * 100 >= F.greatest(f"{left}n", f"{right}n") * PERCENT
    differing = F.bit_count(F.col(f"{left}x").bitwiseXOR(F.col(f"{right}x"))) + F.bit_count(
        F.col(f"{left}y").bitwiseXOR(F.col(f"{right}y"))
    )
    return sizes & (differing <= most_differing_bits())


def document_sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, n_shingles, set, signature, x, y`` of every row; the last four are null without words.

    ``x`` and ``y`` hold the low bits of the signature's places.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, sets, signatures, bits = [], [], [], []
            for value in batch.column(1):
                shingles = shingles_of(value.as_py(), hashes)
                sizes.append(len(shingles))
                if not len(shingles):
                    sets.append(None)
                    signatures.append(None)
                    bits.append((None, None))
                    continue
                signature = signature_of(shingles)
                sets.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                signatures.append(signature.tobytes())
                bits.append(tuple(np.packbits(signature.astype(np.uint8) & 1).view(np.int64).tolist()))
            low, high = zip(*bits) if bits else ((), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(sets, pa.binary()),
                    pa.array(signatures, pa.binary()),
                    pa.array(low, pa.int64()),
                    pa.array(high, pa.int64()),
                ],
                names=["doc_id", "n_shingles", "set", "signature", "x", "y"],
            )

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(narrow, measure, SETS)


def prune(pairs: DataFrame) -> DataFrame:
    """Pairs ``a, b`` with signatures ``sa, sb`` that survive the sequential comparison."""
    steps = needed_matches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, HASHES) for i in (2, 3)
            )
            alive = np.arange(batch.num_rows)
            matches = np.zeros(batch.num_rows, np.int64)
            for n, needed in steps:
                place = slice(n - BATCH, n)
                matches[alive] += (left[alive, place] == right[alive, place]).sum(axis=1)
                alive = alive[matches[alive] >= needed]
            yield batch.select([0, 1]).take(pa.array(alive))

    return map_batches(pairs.select("a", "b", "sa", "sb"), compare, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``c, shingles`` of the wanted classes (``c, doc, set``), read again from their texts.

    ``doc`` is an id under which the class's text is found; another text under
    the same id has another set and is passed over.
    """
    some = wanted.count() <= BROADCAST_IDS
    ids = wanted.select("doc").distinct()
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    texts = narrow.join(F.broadcast(ids) if some else ids, narrow["doc"].eqNullSafe(ids["doc"]), "left_semi")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles_of(value.as_py(), hashes).tobytes() for value in batch.column(0)]
            names = [xxhash.xxh3_128_digest(content) for content in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(sets, pa.binary())], names=["set", "shingles"]
            )

    found = map_batches(texts.select("text"), gather, "set binary, shingles binary")
    return found.join(wanted.select("c", "set"), "set").dropDuplicates(["c"]).select("c", "shingles")


def confirm(pairs: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose full sets ``fa, fb`` are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                left, right = (np.frombuffer(batch.column(k)[i].as_py(), np.uint64) for k in (2, 3))
                common = len(np.intersect1d(left, right, assume_unique=True))
                good.append(100 * common >= PERCENT * (len(left) + len(right) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return map_batches(pairs.select("a", "b", "fa", "fb"), compare, "a long, b long")


def _with_both(pairs: DataFrame, values: DataFrame, column: str, names: tuple[str, str]) -> DataFrame:
    for end, name in zip("ab", names):
        side = values.select(F.col("c").alias(end), F.col(column).alias(name))
        pairs = pairs.join(side, end)
    return pairs


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame | None:
    """The pairs ``a, b`` of classes that are truly linked, staged; None if there are none."""
    survivors = stage(prune(_with_both(pairs, classes, "signature", ("sa", "sb"))), "survivors")
    if survivors.isEmpty():
        return None
    ends = survivors.select(F.col("a").alias("c")).union(survivors.select(F.col("b").alias("c"))).distinct()
    wanted = stage(classes.join(ends, "c").select("c", "doc", "set"), "wanted")
    sets = stage(full_sets(docs, wanted, doc_id, text), "sets")
    return stage(confirm(_with_both(survivors, sets, "shingles", ("fa", "fb"))), "links")


def _as_other(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{name}").alias(f"d{name}") for name in ("comp", "n", "x", "y")]


def first_to_meet(live: DataFrame) -> DataFrame:
    """``key, d, dcomp, dn, dx, dy``: of every bucket the class that meets most others in all buckets together.

    The text that others were made from shares most bands with them, and links
    most of a bucket in one round.
    """
    sizes = live.groupBy("key").agg(F.count("*").alias("met"))
    weights = live.join(sizes, "key").groupBy("c").agg(F.sum("met").alias("weight"))
    first = F.max(F.struct("weight", (-F.col("c")).alias("least"), "comp", "n", "x", "y")).alias("f")
    ranked = live.join(weights, "c").groupBy("key").agg(first)
    return ranked.select("key", (-F.col("f.least")).alias("d"), *_as_other("f."))


def meet_in_cells(live: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The links ``a, b`` between classes of one bucket that are in different components.

    Buckets that share classes form a cluster. A cluster's classes are cut into
    chunks of bounded size and every two chunks meet in a cell of their own, so
    no task holds a cluster and only links leave it. In a cell a pair must
    share a band, then pass the sequential comparison, then the full sets.
    """
    firsts = live.groupBy("key").agg(F.min("c").alias("d"))
    spans = components(live.join(firsts, "key").select(F.col("c").alias("a"), F.col("d").alias("b")))
    members = stage(
        live.select("c", "comp", "n").distinct().join(spans.withColumnRenamed("node", "c"), "c"), "members"
    )
    chunks = members.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / CELL_CLASSES), F.ceil(F.sum("n") * 8 / CELL_BYTES)).cast("int").alias("chunks")
    )
    wanted = stage(classes.join(members.select("c"), "c").select("c", "doc", "set"), "wanted")
    sets = full_sets(docs, wanted, doc_id, text)
    placed = (
        members.join(chunks, "component")
        .join(classes.select("c", "signature"), "c")
        .join(sets, "c")
        .withColumn("chunk", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "component",
            F.least("chunk", "other").alias("low"),
            F.greatest("chunk", "other").alias("high"),
            "chunk",
            "c",
            "comp",
            "signature",
            "shingles",
        )
    )
    steps = needed_matches()

    def meet(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("chunk")
        ids, comps, chunk = (cell.column(name).to_numpy() for name in ("c", "comp", "chunk"))
        signatures = np.frombuffer(b"".join(cell.column("signature").to_pylist()), "<u4").reshape(-1, HASHES)
        found = [np.frombuffer(content, np.uint64) for content in cell.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in found])
        numbers = np.unique(np.concatenate(found), return_inverse=True)[1]
        ends = np.cumsum(sizes)
        low = int((chunk == chunk[0]).sum())
        within = low == len(ids)
        present = np.zeros(int(numbers.max()) + 1, np.int64)
        links: list[tuple[int, int]] = []
        for i in range(low):
            start = i + 1 if within else low
            others = np.arange(start, len(ids))
            others = others[
                (comps[others] != comps[i])
                & (np.minimum(sizes[others], sizes[i]) * 100 >= np.maximum(sizes[others], sizes[i]) * PERCENT)
            ]
            same = signatures[others] == signatures[i]
            fits = same.reshape(-1, BANDS, ROWS).all(axis=2).any(axis=1)
            for n, needed in steps:
                fits &= same[:, :n].sum(axis=1) >= needed
            others = others[fits]
            if not len(others):
                continue
            mine = numbers[ends[i] - sizes[i] : ends[i]]
            present[mine] = 1
            for j in others:
                common = int(present[numbers[ends[j] - sizes[j] : ends[j]]].sum())
                if 100 * common >= PERCENT * (sizes[i] + sizes[j] - common):
                    links.append((int(ids[i]), int(ids[j])))
            present[mine] = 0
        left, right = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return stage(placed.groupBy("component", "low", "high").applyInArrow(meet, "a long, b long"), "links")


def link_classes(classes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame | None:
    """``(node, component)`` of all linked classes; None if nothing is linked."""
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * (4 * ROWS) + 1, F.lit(4 * ROWS))),
    )
    bands = classes.select("c", "n", "x", "y", F.explode(keys).alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("met")).where("met > 1").select("key")
    live = stage(bands.join(shared, "key").withColumn("comp", F.col("c")), "buckets")
    links, found = None, None
    for _ in range(STAR_ROUNDS):
        if live.isEmpty():
            return found
        met = live.join(first_to_meet(live), "key").where("c <> d")
        close = met.where((F.col("comp") != F.col("dcomp")) & may_match("", "d"))
        more = verify(close.select(F.col("c").alias("a"), F.col("d").alias("b")).distinct(), classes, docs, doc_id, text)
        if more is not None:
            links = more if links is None else links.union(more)
            found = components(links)
        rest = met.select("key", "c", "n", "x", "y")
        if found is not None:
            rest = rest.join(found.withColumnRenamed("node", "c"), "c", "left").select(
                "key", "c", "n", "x", "y", F.coalesce("component", "c").alias("comp")
            )
        else:
            rest = rest.withColumn("comp", F.col("c"))
        rest = stage(rest, "buckets")
        unsettled = rest.groupBy("key").agg(F.min("comp").alias("l"), F.max("comp").alias("h")).where("l < h")
        live = stage(rest.join(unsettled.select("key"), "key"), "buckets")
    if live.isEmpty():
        return found
    more = meet_in_cells(live, classes, docs, doc_id, text)
    if more.isEmpty():
        return found
    return components(more if links is None else links.union(more))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Two rows are linked when their five-word shingle sets have a Jaccard
    similarity of at least 0.75; a component is what links reach, named by its
    smallest id, and its rows with that id are kept. Null and empty texts are
    linked with nothing. Rows equal in id and text are one document. Null ids
    come last; a component of null ids alone has a null id and is kept. The chance of missing a link at the threshold is that
    of the bands and of the pruning, about 1e-5.
    """
    rows = stage(document_sets(docs, doc_id, text), "sets")
    some = rows.where(F.col("set").isNotNull())
    classes = stage(
        some.groupBy("set")
        .agg(
            F.min("doc_id").alias("doc"),
            *[F.first(mine).alias(name) for mine, name in (("signature", "signature"), ("n_shingles", "n"), ("x", "x"), ("y", "y"))],
        )
        .withColumn("c", F.monotonically_increasing_id()),
        "classes",
    )
    found = link_classes(classes, docs, doc_id, text)
    narrow = classes.select("set", "c", "doc")
    if found is None:
        named = narrow.select("set", F.col("doc").alias("component_id"))
    else:
        placed = narrow.join(found.withColumnRenamed("node", "c"), "c", "left").withColumn(
            "component", F.coalesce("component", "c")
        )
        least = placed.groupBy("component").agg(F.min("doc").alias("component_id"))
        named = placed.join(least, "component").select("set", "component_id")
    own = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return (
        rows.select("doc_id", "n_shingles", "set")
        .join(named, "set", "left")
        .select("doc_id", "n_shingles", own.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, in their own columns; an id with a kept row keeps all its rows."""
    fates = near_duplicates(docs, doc_id, text).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = stage(fates.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")), "gone")
    small = gone.count() <= BROADCAST_IDS
    mine = F.col(doc_id).cast("long")
    return docs.join(F.broadcast(gone) if small else gone, mine.eqNullSafe(F.col("_gone")), "left_anti")
