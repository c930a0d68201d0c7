"""Registration of queries with their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from suite.domain import Domain, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str, let: dict[str, str] | None = None):
    """Register a function of the domain tables under ``key`` with its equivalent SQL."""

    def register(build: Callable[[Domain], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, directory: build(Domain(spark, directory))
        ORACLE[key] = with_relations(sql, let)
        return build

    return register
