"""Named queries: a Spark builder and, where SQL can say the same, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from actilens.plans.oracle_views import with_views
from actilens.sources.views import Tables


@dataclass(frozen=True)
class Query:
    key: str
    build: Callable[[Tables], DataFrame]
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key``."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if key in REGISTRY:
            raise ValueError(f"query {key} is registered twice")
        REGISTRY[key] = Query(key, fn, sql)
        return fn

    return register


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: q.build(Tables(spark, folder))

    return {key: bind(q) for key, q in REGISTRY.items()}


def oracles() -> dict[str, str]:
    return {key: with_views(q.sql) for key, q in REGISTRY.items() if q.sql}
