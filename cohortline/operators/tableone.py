"""Baseline characteristics table: continuous and categorical variables, overall and by group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortline.functions.cleaning import quoted
from cohortline.functions.features import half_even
from cohortline.functions.stats import chi_square_tail, t_two_sided
from cohortline.operators.describe import summarized
from cohortline.operators.ranks import exact_quantiles, unpivot


def welch(n1: Column, m1: Column, s1: Column, n2: Column, m2: Column, s2: Column) -> tuple[Column, Column]:
    """Welch's t and its degrees of freedom from two sets of moments."""
    v1, v2 = s1 * s1 / n1, s2 * s2 / n2
    t = F.try_divide(m1 - m2, F.sqrt(v1 + v2))
    dof = F.try_divide((v1 + v2) * (v1 + v2),
                       F.try_divide(v1 * v1, n1 - 1) + F.try_divide(v2 * v2, n2 - 1))
    return t, dof


def continuous_table(df: DataFrame, variables: Sequence[str], group: str | None = None,
                     groups: Sequence = (0, 1), p_value: bool = True) -> DataFrame:
    """One row per variable: n, missing, mean, sd, median, min, max, mode; by two groups their
    n, mean and sd, Welch's t, degrees of freedom and p-value."""
    moments: dict[str, Callable[[Column], Column]] = {
        "n": F.count, "missing_n": lambda x: F.count_if(x.isNull()),
        "missing_pct": lambda x: F.try_divide(F.lit(100.0) * F.count_if(x.isNull()), F.count("*")),
        "mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max}
    if group:
        for i, g in enumerate(groups):
            for s, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp)):
                moments[f"{s}_{i}"] = lambda x, f=f, g=g: f(F.when(quoted(group) == g, x))
    long = unpivot(df, [], variables, "variable", "v", cast="double")
    # smallest of the most frequent values
    modes = (long.filter("v is not null").groupBy("variable", "v").agg(F.count("*").alias("c"))
             .groupBy("variable").agg(F.min_by("v", F.struct(-F.col("c"), F.col("v"))).alias("mode")))
    medians = exact_quantiles(df, variables, [0.5]).select("variable", F.col("q0").alias("median"))
    out = summarized(df, variables, moments).join(modes, "variable", "left").join(medians, "variable", "left")
    if group and len(groups) == 2:
        t, dof = welch(*[F.col(f"{s}_{i}") for i in (0, 1) for s in ("n", "mean", "sd")])
        out = out.withColumn("t", t).withColumn("dof", dof)
        if p_value:
            out = out.withColumn("p_value", t_two_sided("t", "dof"))
    return out


def _level_counts(df: DataFrame, variables: Sequence[str], group: str | None, groups: Sequence) -> DataFrame:
    keys = [group] if group else []
    long = unpivot(df, keys, variables, "variable", "level", cast="string").filter("level is not null")
    aggs = [F.count("*").alias("n")]
    if group:
        aggs += [F.count_if(quoted(group) == g).alias(f"n_{i}") for i, g in enumerate(groups)]
    return long.groupBy("variable", "level").agg(*aggs)


def categorical_table(df: DataFrame, variables: Sequence[str], group: str | None = None,
                      groups: Sequence = (0, 1), p_value: bool = True) -> DataFrame:
    """One row per variable and level: count, share, count by group, and the variable's
    chi-square statistic, degrees of freedom and p-value."""
    counts = _level_counts(df, variables, group, groups)
    names = [f"n_{i}" for i in range(len(groups))] if group else []
    totals = counts.groupBy("variable").agg(
        F.sum("n").alias("total"), F.count("*").alias("levels"), *[F.sum(c).alias(f"total_{c}") for c in names])
    out = (counts.join(totals, "variable")
           .withColumn("proportion_pct", F.lit(100.0) * F.col("n") / F.col("total")))
    if not group:
        return out.select("variable", "level", "n", "proportion_pct")
    grouped = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    grand = sum((F.col(f"total_{c}") for c in names[1:]), F.col(f"total_{names[0]}"))
    term = F.lit(0.0)
    for c in names:
        expected = grouped * F.col(f"total_{c}") / grand
        term += F.coalesce(F.try_divide((F.col(c) - expected) * (F.col(c) - expected), expected), F.lit(0.0))
    tests = out.withColumn("term", term).groupBy("variable").agg(
        F.sum("term").alias("chi2"), ((F.first("levels") - 1) * (len(groups) - 1)).cast("int").alias("dof"))
    if p_value:
        tests = tests.withColumn("p_value", chi_square_tail("chi2", "dof"))
    return out.join(tests, "variable").select(
        "variable", "level", "n", "proportion_pct", *names, "chi2", "dof", *(["p_value"] if p_value else []))


def group_headers(df: DataFrame, group: str, groups: Sequence) -> list[str]:
    """Headers such as ``0 (n = 132)``."""
    row = df.agg(*[F.count_if(quoted(group) == g).alias(f"n{i}") for i, g in enumerate(groups)]).first()
    return [f"{g} (n = {row[i]})" for i, g in enumerate(groups)]


def generate_table1(df: DataFrame, include_types: str, variables: Sequence[str], groupby_col: str | None = None,
                    groups: Sequence = (0, 1), decimal_places: int = 2) -> DataFrame:
    """Display form of the table, with group headers that carry the group size."""
    def shown(c: str) -> Column:
        return half_even(F.col(c), decimal_places)

    headers = group_headers(df, groupby_col, groups) if groupby_col else []
    if include_types == "continuous":
        t = continuous_table(df, variables, groupby_col, groups)
        cols = [F.col("variable").alias("Variable"), F.lit("Continuous").alias("Type"),
                *[shown(c).alias(n) for c, n in (("mean", "Mean"), ("sd", "SD"), ("median", "Median"), ("min", "Min"),
                                                 ("max", "Max"), ("mode", "Mode"))],
                F.col("missing_n").alias("Missing (n)"), shown("missing_pct").alias("Missing (%)"),
                F.col("n").alias("Count"),
                half_even(F.lit(100.0) - F.col("missing_pct"), decimal_places).alias("Proportion (%)")]
        cols += [F.concat(shown(f"mean_{i}").cast("string"), F.lit(" ("), shown(f"sd_{i}").cast("string"), F.lit(")"))
                 .alias(h) for i, h in enumerate(headers)]
    elif include_types == "categorical":
        t = categorical_table(df, variables, groupby_col, groups)
        modes = t.groupBy("variable").agg(F.min_by("level", F.struct(-F.col("n"), F.col("level"))).alias("mode"))
        gaps = unpivot(df, [], variables, "variable", "v", cast="string").groupBy("variable").agg(
            F.count_if(F.col("v").isNull()).alias("missing_n"),
            (F.lit(100.0) * F.count_if(F.col("v").isNull()) / F.count("*")).alias("missing_pct"))
        t = t.join(modes, "variable").join(gaps, "variable")
        cols = [F.concat_ws(" = ", "variable", "level").alias("Variable"), F.lit("Categorical").alias("Type"),
                F.col("mode").alias("Mode"), F.col("missing_n").alias("Missing (n)"),
                shown("missing_pct").alias("Missing (%)"), F.col("n").alias("Count"),
                shown("proportion_pct").alias("Proportion (%)")]
        cols += [F.col(f"n_{i}").alias(h) for i, h in enumerate(headers)]
    else:
        raise ValueError("include_types must be 'continuous' or 'categorical'")
    if groupby_col:
        cols.append(half_even(F.col("p_value"), decimal_places).alias("P-value"))
    return t.select(*cols)
