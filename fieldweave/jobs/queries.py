"""All queries of the library, by name."""

from __future__ import annotations

from fieldweave.jobs import aggregates, comparisons, grids, loading, physics, reports

QUERIES = {q.name: q for module in (aggregates, comparisons, physics, grids, reports, loading) for q in module.QUERIES}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: q.oracle() for name, q in QUERIES.items() if q.sql}
