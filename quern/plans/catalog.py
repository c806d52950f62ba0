"""The catalogue of retrieval queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import settle
from . import evaluation_queries, memory_queries, search_queries, text_queries

_PARTS = (search_queries, text_queries, memory_queries, evaluation_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _settled(f) for part in _PARTS for name, f in part.QUERIES.items()}


def _settled(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(settle(spark), sf_dir)


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
