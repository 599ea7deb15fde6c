"""Quality rules judged for a document and for the host it comes from.

Rule failures are counted by host, the hosts' failure rates are shrunk with a
beta prior fitted to all hosts, and a host that fails far too often takes its
documents with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemill.llm.common import map_batches, stage

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host is rejected when this many deviations below its shrunk failure rate still exceed the limit.
DEVIATIONS = 2.0
MAX_HOST_RATE = 0.5
#: Bounds of the fitted prior's weight, in documents.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1_000_000.0

SIGNALS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
# Odd multipliers, one per place in a window.
_WEIGHTS = np.random.default_rng(8).integers(1 << 62, size=WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of ``WINDOW`` words found twice or more."""
    if len(words) <= WINDOW:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(word, len(numbers)) for word in words], np.uint64)
    count = len(ids) - WINDOW + 1
    codes = np.zeros(count, np.uint64)
    for place, weight in enumerate(_WEIGHTS):
        codes += ids[place : place + count] * weight
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    if not same.any():
        return 0
    windows = sliding_window_view(ids, WINDOW)
    left, right = order[:-1][same], order[1:][same]
    equal = np.empty(len(left), bool)
    for at in range(0, len(left), 65_536):
        equal[at : at + 65_536] = (windows[left[at : at + 65_536]] == windows[right[at : at + 65_536]]).all(axis=1)
    if equal.all():
        starts = np.unique(np.concatenate([left, right]))
    else:  # different windows share a code: count the windows themselves
        _, which, seen = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(seen[which.ravel()] > 1)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def signals_of(text: str | None) -> tuple[int, int, int, int, int]:
    """The columns of ``SIGNALS`` for one whole text; all zero for null."""
    if not text:
        return 0, 0, 0, 0, 0
    content = text.encode()
    words = content.split()
    lines = [line for line in content.split(b"\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - len(content) + len(content.translate(None, SPACES)),
        len(content) - len(content.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def with_signals(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns of ``SIGNALS`` and ``base_failed`` to every row.

    Words are runs without ASCII white space. A null text has no words and
    fails. Columns of these names in the input are replaced; texts are read
    whole.
    """
    added = StructType.fromDDL(SIGNALS)
    rest = df.drop(*added.names, "base_failed")
    position = rest.columns.index(text)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [name for name in added.names]
        for batch in batches:
            found = np.array([signals_of(value.as_py()) for value in batch.column(position)], np.int64)
            columns = [pa.array(column) for column in found.reshape(-1, len(names)).T]
            fields = [pa.field(name, pa.int64()) for name in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=pa.schema([*batch.schema, *fields]))

    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    return map_batches(rest, measure, StructType([*rest.schema, *added])).withColumn("base_failed", failed)


def host_rates(judged: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: documents, failures, shrunk rate, its deviation, verdict.

    The beta prior has the mean of all documents and the weight given by the
    spread between hosts, method of moments. A null host is a host like others.
    """
    hosts = judged.groupBy(host).agg(
        F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")
    )
    docs, failed = F.col("host_docs"), F.col("host_failed")
    # Sums over hosts: one row.
    total = hosts.agg(
        F.sum(docs).alias("n"), F.sum(failed).alias("k"), F.sum(failed * failed / docs).alias("kk")
    ).first()
    n, k = total["n"] or 0, total["k"] or 0
    mean = k / n if n else 0.0
    spread = (total["kk"] / n - mean * mean) if n else 0.0
    strength = mean * (1 - mean) / spread - 1 if spread > 1e-12 else MAX_STRENGTH
    strength = min(max(strength, MIN_STRENGTH), MAX_STRENGTH)
    rate = (failed + mean * strength) / (docs + strength)
    return (
        hosts.withColumn("host_rate", rate)
        .withColumn("_deviation", F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (docs + strength + 1)))
        .withColumn("host_rejected", F.col("host_rate") - DEVIATIONS * F.col("_deviation") > MAX_HOST_RATE)
        .drop("_deviation")
    )


def judge(with_signals: DataFrame, host: str = "source") -> DataFrame:
    """Add the host's figures and ``kept`` to rows that carry ``base_failed``.

    The rows are staged once, as both the hosts' counts and the verdicts read
    them. Counts by host are taken with partial sums, and a hot host's rows are
    joined to one row, so AQE can split them.
    """
    rows = stage(with_signals.drop("host_docs", "host_failed", "host_rate", "host_rejected", "kept"), "signals")
    rates = host_rates(rows.select(host, "base_failed"), host).withColumnRenamed(host, "_host")
    joined = rows.join(rates, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``df`` that pass the rules and whose host does, in their own columns."""
    return judge(with_signals(df, text), host).where("kept").select(*[F.col(f"`{name}`") for name in df.columns])
