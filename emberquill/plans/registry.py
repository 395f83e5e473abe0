"""Named queries of the core operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberquill.plans import data_queries, retrieval_queries, state_queries, stream_queries, table_queries, table_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**data_queries.QUERIES, **retrieval_queries.QUERIES, **table_queries.QUERIES, **stream_queries.QUERIES, **state_queries.QUERIES}
SQL: dict[str, str] = {**data_queries.SQL, **retrieval_queries.SQL, **table_sql.SQL, **stream_queries.SQL, **state_queries.SQL}
