"""All queries over the driver's tables, by name, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ["coverage", "edges", "stale", "texts", "orders", "streams", "source_trees", "adoption", "engine_rows"]


class Tables:
    """The tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` as a query."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return f

    return register


def _load() -> None:
    for m in MODULES:
        import_module(f"stratagraph.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
