"""All queries by name, and their DuckDB SQL."""

from __future__ import annotations

from millrace.plans import cache_queries, cdc_queries, extract_queries, search_queries, table_queries, task_queries, text_queries, vector_queries  # noqa: F401  registers queries
from millrace.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
