"""Running values of arrays of numbers, over whole Arrow batches at once.

The arrays of a batch lie end to end in one buffer, so no number passes through
the JVM's interpreted folds and no array is copied per item. The folds in
``tokens`` say the same and remain for comparison.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

import tracemill
from tracemill import fixed_values as fixed

# Workers get this package's functions by value and need no copy of it.
cloudpickle.register_pickle_by_value(tracemill)


def item_lists(lists: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """The items of all lists in one array, and the offsets of the lists in it; a null list is empty."""
    offsets = lists.offsets
    first, last = offsets[0].as_py(), offsets[-1].as_py()
    return lists.values.slice(first, last - first), pc.subtract(offsets, first)


def _products(items: pa.Array, offsets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Running products within every list, and which of them are null: all from a null item on."""
    values = items.cast(pa.float64())
    gaps = np.asarray(pc.is_null(values).to_numpy(zero_copy_only=False))
    given = np.asarray(pc.fill_null(values, 1.0).to_numpy(zero_copy_only=False))
    bounds = offsets.to_numpy()
    out = np.empty(len(given))
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        np.multiply.accumulate(given[start:end], out=out[start:end])
    if not gaps.any():
        return out, gaps
    seen = np.concatenate([[0], np.cumsum(gaps)])
    before = np.repeat(seen[bounds[:-1]], np.diff(bounds))
    return out, seen[1:] - before > 0


def running_product(probabilities: Column) -> Column:
    """Products of an array's numbers up to each of them; null from a null on, and for no array."""

    def multiply(lists: pa.Array) -> pa.Array:
        items, offsets = item_lists(lists)
        products, unknown = _products(items, offsets)
        return pa.ListArray.from_arrays(
            offsets, pa.array(products, mask=unknown), mask=pc.is_null(lists) if lists.null_count else None
        )

    return F.arrow_udf(multiply, "array<double>")(probabilities)


def likely_prefix_length(probabilities: Column, threshold: float = fixed.LIKELIHOOD_THRESHOLD) -> Column:
    """How many leading numbers keep the running product at or above ``threshold``.

    A null ends the prefix; no array has no length.
    """

    def count(lists: pa.Array) -> pa.Array:
        items, offsets = item_lists(lists)
        products, unknown = _products(items, offsets)
        kept = np.concatenate([[0], np.cumsum((products >= threshold) & ~unknown)])
        bounds = offsets.to_numpy()
        lengths = (kept[bounds[1:]] - kept[bounds[:-1]]).astype(np.int32)
        return pa.array(lengths, mask=np.asarray(pc.is_null(lists)))

    return F.arrow_udf(count, "int")(probabilities)
