"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from trawl.plans import admin_queries, document_queries, evaluation_queries, graph_queries, retrieval_queries, stream_queries

_PARTS = [retrieval_queries, graph_queries, admin_queries, evaluation_queries, document_queries, stream_queries]


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for part in _PARTS for name, s in part.SQL.items()}
