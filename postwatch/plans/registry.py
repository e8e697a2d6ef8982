"""Named queries: a Spark plan over the test tables and the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from .views import Views, with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Views], DataFrame]
    sql: str | None
    operators: str


CATALOG: dict[str, Query] = {}


def query(name: str, operators: str, sql: str | None = None):
    """Register ``build(views)`` under ``name``; ``operators`` lists the inventory rows."""

    def register(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(name, build, with_views(sql) if sql else None, operators)
        return build

    return register


def runnable(entry: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return entry.build(Views(configure(spark), sf_dir))

    return run
