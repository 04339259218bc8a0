"""Table comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortline.functions.cleaning import quoted
from cohortline.sources.files import assert_key


def cell_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Cells that differ, as ``(key, column_name, left_value, right_value)`` text.

    A key present on one side only differs in every column. Missing equals missing.
    A missing or repeated key on either side is an error.
    """
    left, right = assert_key(left, key), assert_key(right, key)
    columns = [c for c in left.columns if c != key]
    a = left.select(quoted(key).alias("key"), F.lit(True).alias("in_left"),
                    *[quoted(c).alias(f"l{i}") for i, c in enumerate(columns)])
    b = right.select(quoted(key).alias("key"), F.lit(True).alias("in_right"),
                     *[quoted(c).alias(f"r{i}") for i, c in enumerate(columns)])
    both = a.join(b, "key", "full_outer")
    alone = F.col("in_left").isNull() | F.col("in_right").isNull()
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"l{i}").cast("string").alias("left_value"),
                 F.col(f"r{i}").cast("string").alias("right_value"),
                 (alone | ~F.col(f"l{i}").eqNullSafe(F.col(f"r{i}"))).alias("differs"))
        for i, c in enumerate(columns)])
    return (both.select("key", F.inline(F.filter(cells, lambda s: s["differs"])))
            .drop("differs"))


def compare_dataframes(left: DataFrame, right: DataFrame, key: str) -> tuple[str, DataFrame | None]:
    """First kind of difference: ``shape``, ``columns``, ``types``, ``content`` or ``none``.

    With ``content`` the second value lists the cells; it is lazy, so large differences stay distributed.
    """
    if len(left.columns) != len(right.columns) or left.count() != right.count():
        return "shape", None
    if left.columns != right.columns:
        return "columns", None
    if [f.dataType for f in left.schema.fields] != [f.dataType for f in right.schema.fields]:
        return "types", None
    cells = cell_differences(left, right, key)
    return ("none", None) if cells.isEmpty() else ("content", cells)
