"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from presswave.functions.registry import QUERIES, SQL
from presswave.plans import articles, enrichment, feeds, graphs, keywords, relations, scores, sinks, threads  # noqa: F401
from presswave.sources import queries as sources  # noqa: F401
from presswave.streaming import queries as streams  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
