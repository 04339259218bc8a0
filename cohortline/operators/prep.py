"""Numeric and categorical preparation with explicit fitted state."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from cohortline.functions.cleaning import quoted
from cohortline.operators.columns import fit_one_hot
from cohortline.operators.ranks import sql_name
from cohortline.session import small_table

STATE_SCHEMA = "column_name string, low double, high double, mean double, sd double"


def fit_numeric_state(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min, max, mean and population deviation per column from one aggregate, as state rows."""
    aggs = []
    for i, c in enumerate(columns):
        x = quoted(c).cast("double")
        aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.avg(x).alias(f"m{i}"),
                 F.stddev_pop(x).alias(f"s{i}")]
    r = df.agg(*aggs).first()
    rows = [(c, r[f"a{i}"], r[f"b{i}"], r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(columns)]
    return small_table(df.sparkSession, rows, STATE_SCHEMA)


def number(x: float | None) -> str:
    """Double literal for a SQL expression."""
    return "cast(null as double)" if x is None else f"({float(x)!r}D)"


def prepared_sql(name: str, state: Mapping, how: str) -> str:
    """SQL expression of one prepared column.

    ``minmax`` scales and puts the scaled mean where the value is missing, a constant column
    becomes 0; ``impute`` only fills with the mean; ``standard`` centers and scales by the
    population deviation.
    """
    x = f"cast({sql_name(name)} as double)"
    low, high, mean, sd = (state[k] for k in ("low", "high", "mean", "sd"))
    if how == "minmax":
        if low is None:
            return "0.0D"
        span = (high - low) or 1.0
        return f"coalesce(({x} - {number(low)}) / {number(span)}, {number((mean - low) / span)})"
    if how == "impute":
        return f"coalesce({x}, {number(mean)})"
    if how == "standard":
        return f"({x} - {number(mean or 0.0)}) / {number(sd or 1.0)}"
    raise ValueError("how must be 'minmax', 'impute' or 'standard'")


def standardized(c: Column, mean: float | None, sd: float | None) -> Column:
    return (c.cast("double") - F.lit(mean or 0.0)) / F.lit(sd or 1.0)


def apply_numeric_state(df: DataFrame, state: DataFrame, how: str = "minmax") -> DataFrame:
    """Replace the fitted columns by their prepared form (see :func:`prepared_sql`)."""
    return _prepared(df, [r.asDict() for r in state.collect()], how)


def _prepared(df: DataFrame, state: Sequence[Mapping], how: str, suffix: str = "") -> DataFrame:
    new = {r["column_name"]: f"{prepared_sql(r['column_name'], r, how)} as {sql_name(r['column_name'] + suffix)}"
           for r in state if r["column_name"] in df.columns}
    if suffix:
        return df.selectExpr("*", *new.values())
    return df.selectExpr(*[new.get(n, sql_name(n)) for n in df.columns])


class _Columns(Params):
    columns = Param(Params._dummy(), "columns", "numeric columns", TypeConverters.toListString)
    how = Param(Params._dummy(), "how", "minmax, impute or standard", TypeConverters.toString)
    suffix = Param(Params._dummy(), "suffix", "added to output names; empty replaces the inputs", TypeConverters.toString)
    state = Param(Params._dummy(), "state", "fitted values as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(columns=[], how="minmax", suffix="", state="[]")


class NumericPrep(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage around the numeric state; unlike the built-in scaler it takes missing values
    and maps a constant column to 0."""

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, how: str = "minmax"):
        super().__init__()
        self._set(columns=columns or [], how=how)

    def _fit(self, dataset: DataFrame) -> NumericPrepModel:
        rows = fit_numeric_state(dataset, self.getOrDefault("columns")).collect()
        return NumericPrepModel.from_state(self.getOrDefault("columns"), [r.asDict() for r in rows],
                                           self.getOrDefault("how"))


class NumericPrepModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    @staticmethod
    def from_state(columns: Sequence[str], state: Sequence[dict], how: str = "minmax", suffix: str = ""
                   ) -> NumericPrepModel:
        return NumericPrepModel()._set(columns=list(columns), how=how, suffix=suffix, state=json.dumps(list(state)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return _prepared(dataset, json.loads(self.getOrDefault("state")), self.getOrDefault("how"),
                         self.getOrDefault("suffix"))


def categorical_stages(columns: Sequence[str]) -> list:
    """Indexer and encoder per column. A value unseen in training encodes to all zeros:
    it gets an index of its own, whose slot the encoder drops."""
    return [
        StringIndexer(inputCols=list(columns), outputCols=[f"{c}__index" for c in columns], handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        # with an extra index for unseen values, dropping the last slot drops exactly theirs
        OneHotEncoder(inputCols=[f"{c}__index" for c in columns], outputCols=[f"{c}__vec" for c in columns],
                      dropLast=True),
    ]


def fill_categorical(df: DataFrame, columns: Sequence[str], value: str = "missing") -> DataFrame:
    return df.na.fill(value, subset=list(columns))


def fit_label_codes(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)``: sorted distinct values numbered from 0. Meant for columns of few values."""
    values = [r["value"] for r in fit_one_hot(df, [column]).collect()]
    return small_table(df.sparkSession, [(v, i) for i, v in enumerate(values)], "value string, code int")


def apply_label_codes(df: DataFrame, column: str, state: DataFrame, name: str | None = None) -> DataFrame:
    out = F.lit(None).cast("int")
    for r in state.collect():
        out = F.when(quoted(column).cast("string") == r["value"], r["code"]).otherwise(out)
    return df.withColumn(name or column, out)


# Model families that need no scaling.
UNSCALED_FAMILIES = ("xgb", "cat")


def prep_plan(family: str, feature_selection: bool = False, smote: bool = False) -> dict[str, list[str]]:
    """Preparation steps by model family. Tree boosters skip scaling, and impute only when
    feature selection or synthetic sampling would meet missing values."""
    if family not in UNSCALED_FAMILIES:
        return {"numeric": ["minmax", "impute"], "categorical": ["fill", "one_hot"]}
    if feature_selection or smote:
        return {"numeric": ["impute"], "categorical": ["fill", "one_hot"]}
    return {"numeric": [], "categorical": ["one_hot"]}


def prep_stages(plan: dict[str, list[str]], numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Spark ML stages for a plan."""
    stages: list = []
    if plan["numeric"] and numeric:
        stages.append(NumericPrep(columns=list(numeric), how="minmax" if "minmax" in plan["numeric"] else "impute"))
    if categorical:
        stages += categorical_stages(categorical)
    return stages
