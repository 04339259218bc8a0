"""Two-way tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortline.functions.cleaning import quoted
from cohortline.operators.ranks import unpivot


def crosstab_long(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts in long form ``(row_value, col_value, n)``, for any number of values."""
    return (df.filter(quoted(row).isNotNull() & quoted(col).isNotNull())
            .groupBy(quoted(row).alias("row_value"), quoted(col).alias("col_value"))
            .agg(F.count("*").alias("n")))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence, absent: int | None = 0) -> DataFrame:
    """Counts with one column per listed value, in the listed order.

    Rows with another column value are not counted. Empty cells get ``absent``;
    a listed value that never occurs is filled the same way, or missing with ``None``.
    """
    counts = crosstab_long(df.filter(quoted(col).isin(*values)), row, col)
    cells = [F.sum(F.when(F.col("col_value") == v, F.col("n"))).alias(str(v)) for v in values]
    wide = counts.groupBy("row_value").agg(*cells)
    return wide if absent is None else wide.na.fill(absent, subset=[str(v) for v in values])


def crosstab_reindexed(df: DataFrame, row: str, col: str, order: Sequence) -> DataFrame:
    """Counts in a fixed column order: an empty cell is 0, a column value that never occurs stays missing."""
    counts = crosstab_long(df, row, col)
    listed = [F.sum(F.when(F.col("col_value") == v, F.col("n"))).alias(f"c{i}") for i, v in enumerate(order)]
    wide = counts.groupBy("row_value").agg(*listed)
    seen = counts.agg(F.array(*[F.count_if(F.col("col_value") == v) for v in order]).alias("s")).scalar()
    return wide.select("row_value", *[
        F.when(F.get(seen, F.lit(i)) > 0, F.coalesce(F.col(f"c{i}"), F.lit(0))).alias(str(v))
        for i, v in enumerate(order)])


def crosstab_margins(df: DataFrame, row: str, col: str, values: Sequence, margin: str = "Total") -> DataFrame:
    """Counts with a total row and a total column over the listed values.

    The cube runs on the combined counts, so its four grouping sets never multiply the rows of the table.
    """
    counts = (crosstab_long(df.filter(quoted(col).isin(*values)), row, col)
              .withColumn("row_value", F.col("row_value").cast("string")))
    cube = (counts.cube("row_value").agg(
        F.grouping("row_value").alias("is_total"),
        *[F.coalesce(F.sum(F.when(F.col("col_value") == v, F.col("n"))), F.lit(0)).alias(str(v)) for v in values],
        F.coalesce(F.sum("n"), F.lit(0)).alias(margin)))
    return cube.select(F.when(F.col("is_total") == 1, margin).otherwise(F.col("row_value")).alias("row_value"),
                       *[str(v) for v in values], margin)


def crosstab_row_shares(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """Counts divided by their row sum over the listed values."""
    wide = crosstab(df, row, col, values)
    names = [str(v) for v in values]
    total = sum((F.col(f"`{n}`") for n in names[1:]), F.col(f"`{names[0]}`"))
    return wide.select("row_value", *[(F.col(f"`{n}`") / total).alias(n) for n in names])


def stacked_crosstabs(df: DataFrame, by: str, outcomes: Sequence[str]) -> DataFrame:
    """One long collection of tables, one per outcome column: group x value counts and row percentages.

    The outcomes are stacked first, so all tables come from a single shuffle.
    """
    long = unpivot(df.filter(quoted(by).isNotNull()), [by], outcomes, "table_name", "value", cast="string")
    counts = (long.filter(F.col("value").isNotNull())
              .groupBy("table_name", quoted(by).alias("group_value"), "value").agg(F.count("*").alias("n")))
    totals = counts.groupBy("table_name", "group_value").agg(F.sum("n").alias("total"))
    return counts.join(totals, ["table_name", "group_value"]).select(
        "table_name", "group_value", "value", "n", (F.lit(100.0) * F.col("n") / F.col("total")).alias("percentage"))


def legend_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and share of each category of several columns, over the non-missing rows of each column."""
    long = unpivot(df, [], columns, "variable", "value", cast="string").filter(F.col("value").isNotNull())
    counts = long.groupBy("variable", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("variable").agg(F.sum("n").alias("total"))
    return counts.join(totals, "variable").select("variable", "value", "n",
                                                  (F.col("n") / F.col("total")).alias("proportion"))


def aggregate_scores_by_groups(scores: DataFrame, groups: DataFrame, key: str, score_columns: Sequence[str],
                               grouping_columns: Sequence[str]) -> DataFrame:
    """Sum and mean of each score for class 0 and 1 of each 0/1 grouping column, with shares of their total.

    Returns ``(grouping, score, statistic, class_0, class_1, Total, No Death Percent, Death Percent, Total Percent)``.
    """
    joined = scores.select(key, *score_columns).join(groups.select(key, *grouping_columns), key)
    stacked = unpivot(joined, list(score_columns), grouping_columns, "grouping", "cls", cast="int")
    stats = (stacked.filter(F.col("cls").isin(0, 1)).groupBy("grouping", "cls").agg(
        *[F.sum(F.col(s).cast("double")).alias(f"sum_{i}") for i, s in enumerate(score_columns)],
        *[F.avg(F.col(s).cast("double")).alias(f"mean_{i}") for i, s in enumerate(score_columns)]))
    cells = F.array(*[F.struct(F.lit(s).alias("score"), F.lit(stat).alias("statistic"),
                               F.col(f"{stat}_{i}").alias("v"))
                      for i, s in enumerate(score_columns) for stat in ("sum", "mean")])
    wide = (stats.select("grouping", "cls", F.inline(cells)).groupBy("grouping", "score", "statistic")
            .agg(F.max(F.when(F.col("cls") == 0, F.col("v"))).alias("class_0"),
                 F.max(F.when(F.col("cls") == 1, F.col("v"))).alias("class_1"))
            .withColumn("Total", F.col("class_0") + F.col("class_1"))
            .withColumn("No Death Percent", F.try_divide(F.col("class_0"), F.col("Total")))
            .withColumn("Death Percent", F.try_divide(F.col("class_1"), F.col("Total"))))
    return wide.withColumn("Total Percent", (F.col("No Death Percent") + F.col("Death Percent")) * 100)
