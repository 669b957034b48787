"""Registered queries: a Spark plan, and the SQL that states the same result.

Modules of ``ticklake.plans`` add to ``QUERIES`` when they are imported below."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register the decorated (spark, sf_dir) function under ``name``."""

    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(run, sql)
        return run

    return add


def load() -> dict[str, Query]:
    """All queries; the modules that hold them are imported on first use."""
    from ticklake.plans import books, codecs, scans, times, values  # noqa: F401

    return QUERIES
