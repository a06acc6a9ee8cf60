"""All queries of the reference operators."""

from __future__ import annotations

from . import context_queries, graph_queries, interval_queries, live_queries

QUERIES = {**interval_queries.QUERIES, **graph_queries.QUERIES, **context_queries.QUERIES, **live_queries.QUERIES}
SQL = {**interval_queries.SQL, **graph_queries.SQL, **context_queries.SQL, **live_queries.SQL}
