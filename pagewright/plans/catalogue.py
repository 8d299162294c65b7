"""All registered queries over the given tables, with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import correction_queries, text_queries, usage_queries

PARTS = (text_queries, correction_queries, usage_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for part in PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for part in PARTS for k, s in part.ORACLE_SQL.items()}
