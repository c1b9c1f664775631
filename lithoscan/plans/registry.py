"""All queries over the shared tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import churn_queries, extra_queries, graph_queries, insight_queries, symbol_queries, text_queries, tree_queries

_MODULES = (churn_queries, text_queries, symbol_queries, graph_queries, tree_queries, insight_queries, extra_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
