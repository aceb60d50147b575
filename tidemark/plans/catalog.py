"""Every registered query with its equivalent SQL."""

from __future__ import annotations

from . import graph_queries, market_queries, source_queries, vector_queries

QUERIES = {**market_queries.QUERIES, **vector_queries.QUERIES, **graph_queries.QUERIES, **source_queries.QUERIES}
ORACLE_SQL = {**market_queries.ORACLE_SQL, **vector_queries.ORACLE_SQL, **graph_queries.ORACLE_SQL, **source_queries.ORACLE_SQL}
