"""The list of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Run
    sql: str | Callable[[], str] | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | Callable[[], str] | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under ``name``."""

    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, tuple(covers.split()), run, sql)
        return run

    return register
