"""All queries of the subpackage; importing the query modules registers them."""

from __future__ import annotations

from tracemill.llm import (  # noqa: F401
    queries_audit,
    queries_matches,
    queries_packing,
    queries_rows,
    queries_text,
    queries_trie,
)
from tracemill.llm.registry import BUILDS, SQL

__all__ = ["BUILDS", "SQL"]
