"""Array building blocks that stay linear in the length of the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = 64


def whole_div(value: Column, by: int) -> Column:
    """Integer quotient of a non-negative integer, exact for any size (``/`` goes through doubles)."""
    return F.call_function("div", value, F.lit(by))


def positions(count: Column) -> Column:
    """``0 .. count-1``; empty for zero, where ``sequence(0, -1)`` would descend."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def head(items: Column, count: Column | int) -> Column:
    """First ``count`` items, clipped at both ends."""
    wanted = F.lit(count) if isinstance(count, int) else count
    return F.slice(items, 1, F.greatest(wanted, F.lit(0)).cast("int"))


def drop(items: Column, count: Column | int) -> Column:
    """All items but the first ``count``."""
    skipped = F.lit(count) if isinstance(count, int) else count
    return F.slice(items, (skipped + 1).cast("int"), F.greatest(F.size(items), F.lit(0)))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(items: Column, zero: Column, combine: Callable[[Column, Column], Column], kind: str) -> Column:
    """Running fold of an array of ``kind``, item after item.

    A fold that appends to its own result copies it for every item, which is
    quadratic. Here results are gathered in runs of fixed length, each starting
    from the last result of the run before, so an append copies one run at most.
    """

    def last_of(values: Column) -> Column:
        return F.try_element_at(values, F.lit(-1))

    def run(whole: Column, done: Column, i: Column) -> Column:
        return F.aggregate(
            F.slice(whole, i * RUN + 1, F.lit(RUN)),
            F.array().cast(f"array<{kind}>"),
            lambda part, item: F.array_append(
                part, combine(F.coalesce(last_of(part), last_of(last_of(done)), zero), item)
            ),
        )

    def runs(whole: Column) -> Column:
        return F.aggregate(
            positions(whole_div(F.size(whole) + (RUN - 1), RUN)),
            F.array().cast(f"array<array<{kind}>>"),
            lambda done, i: F.array_append(done, run(whole, done, i)),
        )

    return F.flatten(bind(items, runs))


def join_items(items: Column, separator: str = ",") -> Column:
    return F.array_join(items.cast("array<string>"), separator)
