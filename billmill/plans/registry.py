"""The named queries, each with its SQL twin where SQL can say it."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Named:
    build: Build
    sql: str | None


QUERIES: dict[str, Named] = {}


def query(name: str, sql: str | None = None, model: bool = True) -> Callable[[Build], Build]:
    """Register a query. Its SQL sees the model tables of model_sql unless model is False."""
    from billmill.plans.model_sql import with_model

    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Named(build, with_model(sql) if sql and model else sql)
        return build

    return add
