"""All queries over the sample tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from sheaf.plans import aggregates, files, records, scalars, scripts, streams  # noqa: F401  they register their queries
from sheaf.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
