"""The named queries: each a function of (spark, sf_dir), most with DuckDB SQL of the same result beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name; its tables are read by table(). sql is its oracle."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from codelode.plans import graph_queries, index_queries, project_queries, search_queries, text_queries, vector_queries  # noqa: F401
