"""All queries of the library's own operators and their SQL."""

from __future__ import annotations

from . import cell_queries, route_queries, source_queries

MODULES = (cell_queries, route_queries, source_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
