"""All named queries; importing the query modules registers them."""

from __future__ import annotations

from tracemill.plans import (  # noqa: F401
    curation_queries,
    function_queries,
    grade_queries,
    scoring_queries,
    text_queries,
    token_queries,
    training_queries,
    trajectory_queries,
)
from tracemill.plans.registry import BUILDS, SQL

__all__ = ["BUILDS", "SQL"]
