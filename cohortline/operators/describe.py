"""Counts, group summaries and column profiles."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortline.functions.cleaning import numeric_columns, quoted
from cohortline.functions.features import half_even
from cohortline.operators.ranks import exact_quantiles, sql_name, sql_text, unpivot

QUARTILES = (0.25, 0.5, 0.75)


def value_counts(df: DataFrame, column: str, ascending: bool = False) -> DataFrame:
    """``(value, count)`` of non-missing values by frequency; equal counts follow the value."""
    counts = (df.filter(quoted(column).isNotNull()).groupBy(quoted(column).alias("value"))
              .agg(F.count("*").alias("count")))
    return counts.orderBy(F.asc("count") if ascending else F.desc("count"), "value")


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """:func:`value_counts` with the percentage of all non-missing values.

    The total is a scalar subquery over the same counts, not a window over all values.
    """
    counts = (df.filter(quoted(column).isNotNull()).groupBy(quoted(column).alias("value"))
              .agg(F.count("*").alias("count")))
    total = counts.agg(F.sum("count").alias("total")).scalar()
    return counts.select("value", "count", (F.lit(100.0) * F.col("count") / total).alias("percentage"))


def top_n(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values."""
    return value_counts(df, column).limit(n).select("value")


def group_mean(df: DataFrame, by: str, measure: str, ascending: bool | None = None) -> DataFrame:
    out = (df.filter(quoted(by).isNotNull()).groupBy(quoted(by).alias("group_value"))
           .agg(F.avg(quoted(measure)).alias("mean")))
    if ascending is None:
        return out
    return out.orderBy(F.asc("mean") if ascending else F.desc("mean"), "group_value")


def group_summary(df: DataFrame, by: str, measures: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, min and max of several measures per group, from one shuffle."""
    return summarized(df.filter(quoted(by).isNotNull()), measures, {
        "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}, quoted(by).alias("group_value"))


def summarized(df: DataFrame, columns: Sequence[str], statistics: Mapping[str, Callable[[Column], Column]],
               *by: Column) -> DataFrame:
    """Statistics of every column, ``(*by, variable, *statistics)``.

    All of them are one wide aggregate over the rows; only its few result rows are turned into long form.
    """
    aggs = [f(quoted(c).cast("double")).alias(f"{s}__{i}") for i, c in enumerate(columns) for s, f in statistics.items()]
    wide = df.groupBy(*by).agg(*aggs)
    structs = [f"struct({sql_text(c)} as variable, " + ", ".join(f"`{s}__{i}` as `{s}`" for s in statistics) + ")"
               for i, c in enumerate(columns)]
    keys = [sql_name(c) for c in wide.columns[:len(wide.columns) - len(aggs)]]
    return wide.selectExpr(*keys, f"inline(array({', '.join(structs)}))")


def group_totals(df: DataFrame, by: str, measure: str) -> DataFrame:
    """Sum and mean per group, rounded to two digits."""
    x = quoted(measure)
    return (df.filter(quoted(by).isNotNull()).groupBy(quoted(by).alias("group_value"))
            .agg(half_even(F.sum(x)).alias("total"), half_even(F.avg(x)).alias("mean")))


def describe(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per column.

    Quartiles are exact and interpolated. ``accuracy`` switches to approximate
    ones, which need a single pass; their values then differ.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    basics: dict[str, Callable[[Column], Column]] = {
        "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    if accuracy:
        basics["q"] = lambda x: F.percentile_approx(x, list(QUARTILES), accuracy)
        out = summarized(df, names, basics).select("*", *[F.col("q")[i].alias(f"q{i}") for i in range(3)])
    else:
        out = summarized(df, names, basics).join(exact_quantiles(df, names, QUARTILES).drop("n"), "variable", "left")
    return out.select("variable", "count", "mean", "std", "min", F.col("q0").alias("q25"),
                      F.col("q1").alias("q50"), F.col("q2").alias("q75"), "max")


def dataframe_profiler(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: type, missing count and share, distinct values, most frequent value and its count.

    Every column is counted by itself, in its own type: a scan of that column alone, combined on the map side, so
    what is shuffled is at most its distinct values per task, and only those are ever written as text. A value that
    fills a column is no hot spot. ``approximate=True`` estimates the distinct counts in one pass and leaves the
    values out.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    share = half_even(F.lit(100.0) * F.col("null_total") / F.col("rows"))
    if approximate:
        one = df.agg(F.count("*").alias("rows"), *[f for i, c in enumerate(df.columns) for f in (
            F.count_if(quoted(c).isNull()).alias(f"m{i}"), F.approx_count_distinct(quoted(c)).alias(f"u{i}"))])
        return one.select(F.inline(F.array(*[F.struct(
            F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"), F.col(f"m{i}").alias("null_total"),
            half_even(F.lit(100.0) * F.col(f"m{i}") / F.col("rows")).alias("null_percentage"),
            F.col(f"u{i}").alias("unique_values")) for i, c in enumerate(df.columns)])))
    out = None
    for c in df.columns:
        # maps cannot be grouped by
        value = quoted(c).cast("string") if types[c].startswith("map") else quoted(c)
        counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
        present, text = F.col("value").isNotNull(), F.col("value").cast("string")
        # most frequent first, smaller text on equal counts
        best = F.min(F.when(present, F.struct((-F.col("n")).alias("n"), text.alias("value"))))
        flat = counts.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("null_total"),
            F.count("value").alias("unique_values"), best.alias("best"))
        flat = flat.filter("rows > 0").select(
            F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"), "null_total", share.alias("null_percentage"),
            "unique_values", F.col("best.value").alias("max_unique_value"), (-F.col("best.n")).alias("max_unique_value_total"))
        out = flat if out is None else out.unionByName(flat)
    return out


def column_variances(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Sample variance of every numeric column, ``(variable, variance)``, from one aggregate."""
    names = list(columns) if columns is not None else numeric_columns(df)
    return summarized(df, names, {"variance": F.var_samp})


def low_variance_columns(df: DataFrame, threshold: float = 0.02, columns: Sequence[str] | None = None) -> list[str]:
    """Columns whose variance is below the threshold; an undefined variance keeps the column."""
    rows = column_variances(df, columns).collect()
    return [r["variable"] for r in rows if r["variance"] is not None and r["variance"] < threshold]


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values; missing counts as one."""
    return df.select(quoted(column).alias("value")).distinct()


def class_balance(df: DataFrame, target: str) -> DataFrame:
    return value_shares(df, target)


def head_sorted(df: DataFrame, order: Mapping[str, bool], n: int = 5) -> DataFrame:
    """First rows in a stated order (column -> ascending); a table has no order of its own."""
    return df.orderBy(*[quoted(c).asc() if up else quoted(c).desc() for c, up in order.items()]).limit(n)
