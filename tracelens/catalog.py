"""All registered queries of the log-diagnosis engine and the SQL they are checked against."""

from __future__ import annotations

from .plans import analysis, evidence, parsing, reports, surface


def queries() -> dict:
    """Name to function of (spark, sf_dir)."""
    return {name: q[0] for part in (parsing, evidence, analysis, reports, surface) for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, where SQL can express the query."""
    return {name: q[1] for part in (parsing, evidence, analysis, reports, surface) for name, q in part.QUERIES.items() if q[1]}
