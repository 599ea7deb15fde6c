"""Named queries: a Spark plan over a data folder and, where possible, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.plans.sql_views import with_views

Build = Callable[[SparkSession, str], DataFrame]

BUILDS: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, **local: str) -> Callable[[Build], Build]:
    """Register a query; ``local`` adds SQL views of its own."""

    def register(build: Build) -> Build:
        if name in BUILDS:
            raise ValueError(f"query {name} is registered twice")
        BUILDS[name] = build
        if sql is not None:
            SQL[name] = with_views(sql, **local)
        return build

    return register


def r6(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def round_all(df: DataFrame) -> DataFrame:
    """Round every double to six places, so that summing order does not show."""
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({name: r6(f"`{name}`") for name in doubles}) if doubles else df
