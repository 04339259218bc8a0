"""Cohort selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortline.functions.cleaning import quoted


def minimum_filter(df: DataFrame, column: str, minimum: float) -> DataFrame:
    """Rows at or above a minimum; rows without the value go."""
    return df.filter(quoted(column) >= minimum)


def arm_outcome_filter(df: DataFrame, conditions: Mapping[str, object], score: str | None = None,
                       at_least: float = 0.24) -> DataFrame:
    """Conjunction of equalities, with an optional ``score >= at_least``."""
    keep = F.lit(True)
    for c, v in conditions.items():
        keep &= quoted(c) == v
    if score:
        keep &= quoted(score) >= at_least
    return df.filter(keep)


def exclude_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose value is not listed; rows without a value stay."""
    return df.filter(~F.coalesce(quoted(column).isin(*values), F.lit(False)))


def cohort_flow(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """Row count of every step in one aggregate: ``(position, step, n)``."""
    names = list(steps)
    counts = df.agg(*[F.count_if(F.coalesce(steps[s], F.lit(False))).alias(f"n{i}") for i, s in enumerate(names)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(s).alias("step"), F.col(f"n{i}").alias("n"))
        for i, s in enumerate(names)])))
