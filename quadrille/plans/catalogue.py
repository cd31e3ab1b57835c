"""All queries of the library by name, and the SQL that each is held against."""

from __future__ import annotations

from quadrille.plans import (
    crawl_queries,
    entity_queries,
    graph_queries,
    pipeline_queries,
    profile_queries,
    reason_queries,
    relational_queries,
    search_queries,
)

_MODULES = (relational_queries, graph_queries, profile_queries, entity_queries, reason_queries, search_queries, crawl_queries, pipeline_queries)
QUERIES: dict = {}
SQL: dict = {}
for _m in _MODULES:
    QUERIES.update(_m.BOOK.queries)
    SQL.update(_m.BOOK.sql)
