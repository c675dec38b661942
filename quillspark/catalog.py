"""All queries of the library and their equivalents in SQL, by name."""

from __future__ import annotations

from .plans import store_queries, text_queries, write_queries  # noqa: F401 - they register their queries
from .plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
