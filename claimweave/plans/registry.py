"""The registered queries of the engine, and for each that SQL can express its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimweave.plans.graph import Graph, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of a Graph under its name."""

    def keep(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Graph(spark, folder))
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return keep
