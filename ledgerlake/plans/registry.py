"""All registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
SECTIONS = ("scans", "predicates", "joins", "aggregates", "windows", "events", "scalars", "retrieval", "validation", "operations", "filings", "streams")
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


class Tables:
    """The tables of one folder as attributes, each a scan that Catalyst prunes and filters."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its own name, with the SQL that gives the same rows."""

    def add(plan: Callable[[Tables], DataFrame]):
        name = plan.__name__
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql:
            _oracles[name] = sql
        return plan

    return add


def _load() -> None:
    for section in SECTIONS:
        import_module(f"ledgerlake.plans.{section}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
