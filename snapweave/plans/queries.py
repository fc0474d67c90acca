"""All registered queries of the archive operators."""

from __future__ import annotations

from . import catalog_queries, content_queries, source_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
