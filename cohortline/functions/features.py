"""Row-local feature derivations. All are plain column expressions, so filters push through them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortline.functions.cleaning import coerce_number, quoted

# Unit factors.
KG_PER_LB = 0.45359237
M_PER_INCH = 0.0254
CM_PER_M = 100.0

# Age band edges.
AGE_EDGES = (18, 30, 40, 50, 60, 70, 80, 90, 100)


def half_even(c: Column, digits: int = 2) -> Column:
    """Round on the scaled value, halves to even. The added zero turns -0.0 into 0.0."""
    scale = F.lit(float(10 ** digits))
    return F.rint(c.cast("double") * scale) / scale + F.lit(0.0)


def to_kg(c: Column, unit: str = "kg") -> Column:
    if unit not in ("kg", "lbs"):
        raise ValueError(f"unknown weight unit {unit!r}")
    return c * F.lit(KG_PER_LB) if unit == "lbs" else c


def to_metres(c: Column, unit: str = "m") -> Column:
    if unit not in ("m", "in", "cm"):
        raise ValueError(f"unknown height unit {unit!r}")
    if unit == "in":
        return c * F.lit(M_PER_INCH)
    return c / F.lit(CM_PER_M) if unit == "cm" else c


def bmi(weight: Column, height: Column, weight_unit: str = "kg", height_unit: str = "m") -> Column:
    h = to_metres(height.cast("double"), height_unit)
    return half_even(F.try_divide(to_kg(weight.cast("double"), weight_unit), h * h))


def bmi_category(c: Column, gaps: str = "obese") -> Column:
    """BMI class. By default values in [24.9, 25) and [29.9, 30) and missing ones fall to the last class;
    ``gaps="who"`` closes the gaps upward and keeps missing values missing."""
    if gaps not in ("obese", "who"):
        raise ValueError("gaps must be 'obese' or 'who'")
    if gaps == "who":
        return (F.when(c < 18.5, "Underweight").when(c < 25, "Normal_Weight")
                .when(c < 30, "Overweight").when(c >= 30, "Obese"))
    return (F.when(c < 18.5, "Underweight")
            .when((c >= 18.5) & (c < 24.9), "Normal_Weight")
            .when((c >= 25) & (c < 29.9), "Overweight")
            .otherwise("Obese"))


def pressure_texts(c: Column) -> tuple[Column, Column]:
    parts = F.split(c, "/")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def pressure_parts(c: Column) -> tuple[Column, Column]:
    """Systolic and diastolic part of "SBP/DBP" text; a part that is no number is missing."""
    systolic, diastolic = pressure_texts(c)
    return coerce_number(systolic), coerce_number(diastolic)


def mean_pressure(systolic: Column, diastolic: Column) -> Column:
    return half_even(diastolic + (systolic - diastolic) / F.lit(3.0))


def calculate_bmi(df: DataFrame, weight_col: str, height_col: str, weight_unit: str = "kg",
                  height_unit: str = "m", bmi_col: str = "BMI") -> DataFrame:
    """Adds the BMI column; the inputs keep their unit."""
    return df.withColumn(bmi_col, bmi(quoted(weight_col), quoted(height_col), weight_unit, height_unit))


def calculate_bmi_category(df: DataFrame, bmi_col: str = "BMI", bmi_category_col: str = "BMI_Category",
                           gaps: str = "obese") -> DataFrame:
    return df.withColumn(bmi_category_col, bmi_category(quoted(bmi_col), gaps))


def split_bp_column(df: DataFrame, combined_bp_col: str, systolic_col_name: str = "SBP",
                    diastolic_col_name: str = "DBP") -> DataFrame:
    systolic, diastolic = pressure_parts(quoted(combined_bp_col))
    return df.withColumns({systolic_col_name: systolic, diastolic_col_name: diastolic})


def calculate_map(df: DataFrame, map_col_name: str = "MAP", systolic_col: str | None = None,
                  diastolic_col: str | None = None, combined_bp_col: str | None = None,
                  on_error: str = "raise") -> DataFrame:
    """Mean arterial pressure from two columns or one composite column.

    Composite text that is no pair of numbers is an error, or missing with ``on_error="null"``.
    """
    if on_error not in ("raise", "null"):
        raise ValueError("on_error must be 'raise' or 'null'")
    if systolic_col and diastolic_col:
        return df.withColumn(map_col_name, mean_pressure(quoted(systolic_col), quoted(diastolic_col)))
    if not combined_bp_col:
        raise ValueError("give systolic_col and diastolic_col, or combined_bp_col")
    c = quoted(combined_bp_col)
    value = mean_pressure(*pressure_parts(c))
    if on_error == "raise":
        bad = [t.isNotNull() & coerce_number(t).isNull() for t in pressure_texts(c)]
        message = F.concat(F.lit("not a blood pressure: "), c)
        value = F.when(bad[0] | F.coalesce(bad[1], F.lit(False)), F.raise_error(message).cast("double")).otherwise(value)
    return df.withColumn(map_col_name, value)


def binary_encode(c: Column, zero_value: str) -> Column:
    """0 for one value, 1 for every other, missing included."""
    return F.when(c == zero_value, 0).otherwise(1)


def presence_flag(c: Column) -> Column:
    """0 where the cell is the number zero, 1 otherwise, missing included. Text "0" counts as zero:
    a typed column cannot tell it from the number."""
    return F.when(c.cast("string").try_cast("double") == 0, 0).otherwise(1)


def mention_flag(c: Column, word: str) -> Column:
    """1 where the text contains ``word`` in any case, else 0."""
    return F.coalesce(F.contains(F.upper(c), F.lit(word.upper())), F.lit(False)).cast("int")


def any_flag(*flags: Column) -> Column:
    """OR of 0/1 columns."""
    out = flags[0].cast("int")
    for f in flags[1:]:
        out = out.bitwiseOR(f.cast("int"))
    return out


def row_max(*cols: Column) -> Column:
    """Largest non-missing value across columns."""
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def band_labels(edges: Sequence[float]) -> list[str]:
    """Labels such as ``18-29``: lower edge to one below the upper edge."""
    return [f"{lo:g}-{hi - 1:g}" for lo, hi in zip(edges, edges[1:])]


def band(c: Column, edges: Sequence[float] = AGE_EDGES, labels: Sequence[str] | None = None,
         closed: str = "right") -> Column:
    """Label of the interval a value falls into; values outside all intervals are missing.

    ``closed="right"`` means (lo, hi], so the lowest edge itself is outside;
    ``closed="left"`` means [lo, hi), so the highest edge is outside.
    """
    if closed not in ("right", "left"):
        raise ValueError("closed must be 'right' or 'left'")
    names = list(labels) if labels is not None else band_labels(edges)
    if len(names) != len(edges) - 1:
        raise ValueError("one label per interval is needed")
    out = None
    for lo, hi, name in zip(edges, edges[1:], names):
        inside = (c > lo) & (c <= hi) if closed == "right" else (c >= lo) & (c < hi)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def band_order(c: Column, edges: Sequence[float] = AGE_EDGES, closed: str = "right") -> Column:
    """Position of the band, for sorting labels in value order."""
    return band(c, edges, [str(i) for i in range(len(edges) - 1)], closed).cast("int")


def create_stratified_other_column(df: DataFrame, stratify_list: Sequence[str], other_columns: Sequence[str] = (),
                                   other_column: str | None = None, patient_id: str = "patient_id",
                                   age: str | None = None, age_bin: str | None = None,
                                   bin_ages: Sequence[float] | None = None) -> DataFrame:
    """Strata for a split: the listed columns, one "other" column as the row maximum of several,
    and an age band that is never missing."""
    present = set(df.columns)
    absent = [c for c in [*stratify_list, *other_columns] if c not in present]
    if absent:
        raise KeyError(f"columns not found: {absent}")
    chosen = {c: quoted(c) for c in [patient_id, *stratify_list] if c in present}
    if other_column:
        if other_columns:
            chosen[other_column] = row_max(*[quoted(c) for c in other_columns])
        elif other_column in present:
            chosen[other_column] = quoted(other_column)
    if age and age_bin and bin_ages:
        labels = [f"({lo:g}, {hi:g}]" for lo, hi in zip(bin_ages, bin_ages[1:])]
        chosen[age_bin] = F.coalesce(band(quoted(age), bin_ages, labels), F.lit("Unknown"))
    return df.select(*[c.alias(n) for n, c in chosen.items()])


def threshold_class(p: Column, threshold: float | Column) -> Column:
    """1 where the probability is strictly above the threshold, else 0."""
    return (p > threshold).cast("int")


def confusion_flags(y: Column, predicted: Column) -> dict[str, Column]:
    """Per-row TP, FN, FP and TN as 0/1 columns."""
    return {
        "TP": ((y == 1) & (predicted == 1)).cast("int"),
        "FN": ((y == 1) & (predicted == 0)).cast("int"),
        "FP": ((y == 0) & (predicted == 1)).cast("int"),
        "TN": ((y == 0) & (predicted == 0)).cast("int"),
    }
