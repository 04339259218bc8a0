"""Correlations and best-fit lines for column pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohortline.functions.cleaning import numeric_columns, quoted

def _gram_blocks(names: Sequence[str], centers: Sequence[float]):
    """Per-batch pairwise-complete sums as matrix products; one (i, j) block per input partition."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x = batch[list(names)].to_numpy(dtype="float64") - np.asarray(centers)
            m = np.isfinite(x)
            x0 = np.where(m, x, 0.0)
            mf = m.astype("float64")
            block = np.stack([mf.T @ mf, x0.T @ mf, (x0 * x0).T @ mf, x0.T @ x0])
            total = block if total is None else total + block
        if total is None:
            return
        i, j = np.triu_indices(len(names))
        yield pd.DataFrame({"i": i, "j": j, "n": total[0][i, j], "sx": total[1][i, j], "sy": total[1][j, i],
                            "sxx": total[2][i, j], "syy": total[2][j, i], "sxy": total[3][i, j]})
    return run


def pearson(a: Column, b: Column) -> Column:
    """Pearson r over the rows where both are present, missing when either is constant there.
    (The built-in ``corr`` fails on a constant column in ANSI mode.)"""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, columns: Sequence[str] | None = None, full: bool = False) -> DataFrame:
    """Pearson r of every column pair over the rows where both are present: ``(x, y, r)``.

    The triangle including the diagonal, or with ``full`` the whole matrix. NaN and
    infinite values count as missing; r is missing where a column is constant or has no
    rows. Each partition builds its pairwise sums as matrix products, so the
    shuffle carries columns squared, not rows. A first pass over the columns gives the
    means around which the sums stay accurate.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    numbers = [quoted(n).cast("double") for n in names]
    centers = df.agg(*[F.avg(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)).alias(f"m{i}")
                       for i, x in enumerate(numbers)]).first()
    # columns travel by position: names may be any text
    sums = (df.select(*[x.alias(f"c{i}") for i, x in enumerate(numbers)])
            .mapInPandas(_gram_blocks([f"c{i}" for i in range(len(names))], [0.0 if v is None else v for v in centers]),
                         "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
            .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]))
    n = F.col("n")
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    label = F.array(*[F.lit(c) for c in names])
    # rounding can leave a constant column a variance slightly off zero
    flat = (vx <= F.col("sxx") * 1e-14) | (vy <= F.col("syy") * 1e-14)
    out = sums.select(F.get(label, "i").alias("x"), F.get(label, "j").alias("y"),
                      F.when(~flat, F.try_divide(cov, F.sqrt(vx * vy))).alias("r"))
    if full:
        mirrored = out.filter(F.col("x") != F.col("y")).select(F.col("y").alias("x"), F.col("x").alias("y"), "r")
        out = out.unionByName(mirrored)
    return out


def column_pairs(all_vars: Sequence[str] = (), exclude: Sequence[tuple[str, str]] = (),
                 x_vars: Sequence[str] = (), y_vars: Sequence[str] = ()) -> list[tuple[str, str]]:
    """All pairs of ``all_vars``, or ``x_vars`` against ``y_vars``, without the excluded ones in either order."""
    pairs = [(x, y) for x in x_vars for y in y_vars] if x_vars and y_vars else list(combinations(all_vars, 2))
    gone = {frozenset(p) for p in exclude}
    return [p for p in pairs if frozenset(p) not in gone]


def pair_fits(df: DataFrame, pairs: Sequence[tuple[str, str]], hue: str | None = None) -> DataFrame:
    """Least-squares line and r for each pair, per hue group when given:
    ``([hue_value,] x, y, n, slope, intercept, r)``."""
    aggs = []
    for i, (x, y) in enumerate(pairs):
        a, b = quoted(x).cast("double"), quoted(y).cast("double")
        aggs += [F.regr_count(b, a).alias(f"n{i}"), F.regr_slope(b, a).alias(f"s{i}"),
                 F.regr_intercept(b, a).alias(f"i{i}"), pearson(a, b).alias(f"r{i}")]
    if hue:
        wide = df.filter(quoted(hue).isNotNull()).groupBy(quoted(hue).alias("hue_value")).agg(*aggs)
    else:
        wide = df.agg(*aggs)
    return wide.select(*(["hue_value"] if hue else []), F.inline(F.array(*[
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("slope"),
                 F.col(f"i{i}").alias("intercept"), F.col(f"r{i}").alias("r"))
        for i, (x, y) in enumerate(pairs)])))
