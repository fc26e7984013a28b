"""All registered queries with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_graph, queries_sources, queries_store, queries_tables, queries_text

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (queries_graph, queries_tables, queries_text, queries_sources, queries_store):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
