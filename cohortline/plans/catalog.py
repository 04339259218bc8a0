"""Named queries over the given tables, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortline.functions.features import half_even
from cohortline.plans.views import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its check."""
    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build
    return add


def r(expression: str, digits: int = 6) -> str:
    """SQL for rounding half to even."""
    return f"(round_even(({expression})::DOUBLE * 1e{digits}, 0) / 1e{digits} + 0e0)"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round columns so that summation order does not show."""
    return df.withColumns({c: half_even(F.col(f"`{c}`"), digits) for c in columns})


def load() -> None:
    """Import every module that registers queries."""
    from cohortline.plans import (  # noqa: F401
        describing, evaluating, explaining, modeling_queries, preparing, resampling, storing)


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()

    def bind(build):
        return lambda spark, folder: build(Tables(spark, folder))

    return {name: bind(build) for name, build in QUERIES.items()}


def checks() -> dict[str, str]:
    load()
    return dict(CHECKS)
