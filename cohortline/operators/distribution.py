"""Histograms, densities, reference lines and box-plot statistics."""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial, pi, sqrt

from pyspark.sql import DataFrame, functions as F

from cohortline.functions.cleaning import quoted
from cohortline.operators.describe import QUARTILES, summarized
from cohortline.operators.ranks import exact_quantiles, unpivot
from cohortline.session import materialize

MOMENTS, REACH = 18, 39.0


def histogram(df: DataFrame, column: str, bins: int = 10, low: float | None = None,
              high: float | None = None) -> DataFrame:
    """Count and density of equal bins ``(bin, bin_low, bin_high, n, density)``.

    Bins are closed on the left, the last one on both sides. Values outside are
    dropped. Without limits the range of the data is used.
    """
    x = quoted(column).cast("double")
    if low is None or high is None:
        found = df.agg(F.min(x), F.max(x)).first()
        if found[0] is None:
            raise ValueError(f"{column} has no values")
        low = found[0] if low is None else low
        high = found[1] if high is None else high
        if low == high:
            low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    position = F.least(F.floor((x - F.lit(float(low))) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = (df.filter((x >= low) & (x <= high)).groupBy(position.alias("bin")).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.lit(float(low)) + F.col("bin") * F.lit(width)).alias("bin_low"),
        (F.lit(float(low)) + (F.col("bin") + 1) * F.lit(width)).alias("bin_high"),
        n.alias("n"), (n / (total * F.lit(width))).alias("density"))


def kernel_density(df: DataFrame, column: str, low: float, high: float, points: int = 500) -> DataFrame:
    """Gaussian density with Scott's bandwidth at evenly spaced points: ``(point, x, density)``.

    Values are summed up in cells of half a bandwidth h, by their moments about the cell's center: with
    t = (x - center) / h and u = (value - center) / h, the kernel is exp(-t^2/2) exp(-u^2/2) sum_k (t u)^k / k!, so
    ``MOMENTS`` sums per cell serve every point. As |u| is at most 1/4, what is cut off is below 1e-15 of the kernel's
    peak per value; points beyond ``REACH`` bandwidths get less than the smallest double. One aggregate over the
    rows; what follows is bounded by cells and points, whatever the number of rows or distinct values.
    """
    x = quoted(column).cast("double")
    present = df.filter(x.isNotNull()).select(x.alias("v"))
    moments = present.agg(F.struct(
        (F.stddev_samp("v") * F.pow(F.count("v").cast("double"), F.lit(-0.2))).alias("h"),
        F.count("v").alias("n")).alias("s")).scalar()
    step = (high - low) / (points - 1)
    h = moments["h"]
    # values that reach no point are left out, which also bounds the number of cells
    near = present.filter(F.col("v").between(F.lit(float(low)) - REACH * h, F.lit(float(high)) + REACH * h))
    placed = near.select("v", F.floor(F.try_divide(F.col("v") - F.lit(float(low)), h / 2)).alias("cell"))
    u = F.try_divide(F.col("v") - (F.lit(float(low)) + (F.col("cell") + 0.5) * h / 2), h)
    weighed = placed.select("cell", u.alias("u"), F.exp(F.lit(-0.5) * u * u).alias("w"))
    cells = weighed.groupBy("cell").agg(*[F.sum(F.col("w") * F.pow("u", F.lit(float(k)))).alias(f"m{k}") for k in range(MOMENTS)])
    center = F.lit(float(low)) + (F.col("cell") + 0.5) * h / 2
    first = F.greatest(F.lit(0), F.ceil((center - REACH * h - F.lit(float(low))) / step))
    last = F.least(F.lit(points - 1), F.floor((center + REACH * h - F.lit(float(low))) / step))
    met = cells.filter(first <= last).select("*", F.explode(F.sequence(first, last)).alias("point"))
    t = F.col("t")
    series = F.lit(0.0)
    for k in reversed(range(MOMENTS)):
        series = series * t + F.col(f"m{k}") / float(factorial(k))
    mass = (met.withColumn("t", (F.lit(float(low)) + F.col("point") * F.lit(step) - center) / h)
            .groupBy("point").agg(F.sum(F.exp(F.lit(-0.5) * t * t) * series).alias("mass")))
    grid = df.sparkSession.range(points).select(F.col("id").alias("point"))
    density = F.try_divide(F.coalesce(F.col("mass"), F.lit(0.0)), F.lit(sqrt(2 * pi)) * h * moments["n"])
    return grid.join(mass, "point", "left").select(
        F.col("point").cast("int").alias("point"), (F.lit(float(low)) + F.col("point") * F.lit(step)).alias("x"), density.alias("density"))


def sigma_bands(df: DataFrame, columns: Sequence[str], levels: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Mean, median and mean +- k deviations per column, in long form ``(variable, line, x)``."""
    base = summarized(df, columns, {"mean": F.avg, "std": F.stddev_samp}).join(
        exact_quantiles(df, columns, [0.5]), "variable", "left")
    lines = [("mean", F.col("mean")), ("median", F.col("q0"))]
    for k in levels:
        lines += [(f"mean-{k}sd", F.col("mean") - k * F.col("std")), (f"mean+{k}sd", F.col("mean") + k * F.col("std"))]
    return base.select("variable", F.inline(F.array(*[F.struct(F.lit(n).alias("line"), c.alias("x"))
                                                      for n, c in lines])))


def box_stats(df: DataFrame, by: str, measures: Sequence[str]) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count per (group, measure).

    A whisker is the most extreme value inside its fence. Returns
    ``(group_value, variable, n, q1, median, q3, whisker_low, whisker_high, outliers)``.
    """
    source = _grouped(df, by, measures)
    fences = _quartiles(source, measures).groupBy("group_value").agg(F.map_from_entries(F.collect_list(
        F.struct("variable", F.struct("n", "q0", "q1", "q2")))).alias("__f"))
    aggs = []
    for i, c in enumerate(measures):
        v, f = quoted(c).cast("double"), F.col("__f")[c]
        reach = 1.5 * (f["q2"] - f["q0"])
        outlier = (v < f["q0"] - reach) | (v > f["q2"] + reach)
        aggs += [F.first(f).alias(f"f{i}"), F.min(F.when(~outlier, v)).alias(f"a{i}"), F.max(F.when(~outlier, v)).alias(f"b{i}"),
                 F.count_if(outlier).alias(f"o{i}")]
    # one row per group; every row is read once for all measures
    found = source.join(fences, "group_value").groupBy("group_value").agg(*aggs)
    return found.select("group_value", F.inline(F.array(*[F.struct(
        F.lit(c).alias("variable"), F.col(f"f{i}.n").alias("n"), F.col(f"f{i}.q0").alias("q1"), F.col(f"f{i}.q1").alias("median"),
        F.col(f"f{i}.q2").alias("q3"), F.col(f"a{i}").alias("whisker_low"), F.col(f"b{i}").alias("whisker_high"),
        F.col(f"o{i}").alias("outliers")) for i, c in enumerate(measures)]))).filter("n is not null")


def box_outliers(df: DataFrame, by: str, measures: Sequence[str], key: str) -> DataFrame:
    """Rows beyond the fences: ``(key, group_value, variable, v)``."""
    return (_fenced(df, by, measures, [key]).filter("outlier")
            .select(quoted(key), "group_value", "variable", "v"))


def _grouped(df: DataFrame, by: str, measures: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    return df.select(quoted(by).alias("group_value"), *[quoted(c) for c in [*extra, *measures]]).filter(
        F.col("group_value").isNotNull())


def _quartiles(source: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Written out, so their true size decides how they are joined to the rows."""
    return materialize(exact_quantiles(source, measures, QUARTILES, ["group_value"]), "quartiles")


def _fenced(df: DataFrame, by: str, measures: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    source = _grouped(df, by, measures, extra)
    long = unpivot(source, ["group_value", *extra], measures, "variable", "v", cast="double").filter("v is not null")
    reach = 1.5 * (F.col("q2") - F.col("q0"))
    return (long.join(_quartiles(source, measures), ["group_value", "variable"])
            .withColumn("outlier", (F.col("v") < F.col("q0") - reach) | (F.col("v") > F.col("q2") + reach)))
