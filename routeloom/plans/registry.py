"""What registers a query, and the SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from routeloom.plans.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, views: tuple[str, ...] = ()):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"there is a query {f.__name__} already")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: view(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        if oracle:
            head, body = with_views(*views) if views else "", oracle.lstrip()
            if views and body.startswith("WITH RECURSIVE "):
                head, body = head.replace("WITH ", "WITH RECURSIVE ", 1) + ",", body.removeprefix("WITH RECURSIVE ")
            ORACLES[f.__name__] = f"{head}\n{body}"
        return f

    return add
