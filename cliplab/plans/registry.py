"""Query registry: a name, a Spark plan and, where SQL can say it, the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cliplab.plans.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(Views(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = plan.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register
