"""All queries of the library but those of optional subpackages."""

from __future__ import annotations

from lodestone.plans import file_queries, graph_queries, kg_queries, more_queries, scalar_queries, store_queries, table_queries

_PARTS = (scalar_queries.registry, table_queries.registry, graph_queries.registry, more_queries.registry, store_queries.registry, kg_queries.registry, file_queries.registry)


def queries() -> dict:
    return {k: f for r in _PARTS for k, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for r in _PARTS for k, q in r.sql.items()}
