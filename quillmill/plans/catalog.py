"""All queries of the core with their SQL."""

from __future__ import annotations

from quillmill.plans import documents, exchange, fields, records, relational, scans, search

FLAGSHIP = "run_latest"
_PARTS = (documents, exchange, fields, records, relational, scans, search)


def queries() -> dict:
    """Query name -> (spark, folder) -> DataFrame."""
    return {name: f for part in _PARTS for name, (f, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL over the same tables."""
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
