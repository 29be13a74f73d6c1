"""All named queries and the SQL that must give the same rows."""

from __future__ import annotations

from engram.plans import queries_graph, queries_rest, queries_search, queries_store  # noqa: F401  (they register themselves)
from engram.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
