"""Renaming, choosing and recoding columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortline.functions.cleaning import numeric_columns, quoted, string_columns
from cohortline.operators.ranks import hashed_rank
from cohortline.session import small_table

# Raw headers and the names used after cleaning.
CLINICAL_NAMES = {
    "Age (y)": "Age_years",
    "Height (m)": "Height_m",
    "Weight (Kg)": "Weight_kg",
    "Geographical Origin": "Geographical_Origin",
    "Cultural / Religious affiliation": "Cultural_Religious_Affiliation",
    "Preoperative drugs (antibiotic)": "Preop_drugs_antibiotic",
    "Preoperative Blood Pressure (mmHg)": "Preop_Blood_Pressure_mmHg",
    "Preoperative Heart Rate (bpm)": "Preop_Heart_Rate_bpm",
    "Preoperative Pulse Oxymetry (%)": "Preop_Pulse_Ox_Percent",
    "Surgical Technique": "Surgical_Technique",
    "Anesthesia Type": "Anesthesia_Type",
    "Intraoperative drugs": "Intraoperative_drugs",
    "Intraoperative Blood Loss (ml)": "Intraoperative_Blood_Loss_ml",
    "Intraoperative Mean Blood Pressure (mmHg)": "Intraop_Mean_Blood_Pressure_mmHg",
    "Intraoperative Mean Heart Rate (bpm)": "Intraop_Mean_Heart_Rate_bpm",
    "Intraoperative Mean Pulse Oxymetry (%)": "Intraop_Mean_Pulse_Ox_Percent",
    "Surgical Time (min)": "Surgical_Time_min",
    "Functional Outcomes (pain)": "Functional_Outcomes_Pain",
    "Functional Outcomes (Bleeding)": "Functional_Outcomes_Bleeding",
    "Functional Outcomes (Edema)": "Functional_Outcomes_Edema",
    "Functional Outcomes (Infection)": "Functional_Outcomes_Infection",
    "Functional Outcomes (Fast Recovery)": "Functional_Outcomes_Fast_Recovery",
    "Functional Outcomes (Cosmetic Satisfaction)": "Functional_Outcomes_Cosmetic_Satisfaction",
    "Cost of Procedure (€)": "Cost_of_Procedure_euros",
    "Cost Type": "Cost_Type",
}


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by map; names the table does not have are ignored."""
    return df.select(*[quoted(c).alias(names.get(c, c)) for c in df.columns])


def columns_matching(df: DataFrame, contains: str | None = None, prefix: str | None = None,
                     not_suffix: str | None = None) -> list[str]:
    """Column names by substring, prefix and excluded suffix, in table order."""
    return [c for c in df.columns
            if (contains is None or contains in c)
            and (prefix is None or c.startswith(prefix))
            and (not_suffix is None or not c.endswith(not_suffix))]


def extract_relevant_days_hcc_ccs_columns(df: DataFrame) -> list[str]:
    """Sorted names with ``Daysto``, or with ``HCC`` / ``CCS`` unless that is the ending."""
    chosen = set(columns_matching(df, contains="Daysto"))
    for code in ("HCC", "CCS"):
        chosen.update(columns_matching(df, contains=code, not_suffix="_" + code))
    return sorted(chosen)


def columns_by_type(df: DataFrame, kind: str) -> list[str]:
    """``"numeric"`` or ``"string"`` columns."""
    return {"numeric": numeric_columns, "string": string_columns}[kind](df)


def columns_with_more_values(df: DataFrame, limit: int = 2, columns: Sequence[str] | None = None) -> list[str]:
    """Numeric columns with more than ``limit`` distinct values.

    Exact and without a shuffle of the values: every pass finds the next
    smallest and next largest value of all undecided columns in one aggregate,
    so ``limit + 1`` values take half as many scans.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    lows: dict[str, object] = {}
    highs: dict[str, object] = {}
    seen = dict.fromkeys(names, 0)
    open_names = list(names)
    while open_names:
        aggs = []
        for i, n in enumerate(open_names):
            c = quoted(n)
            inside = ((c > F.lit(lows[n])) & (c < F.lit(highs[n]))) if n in lows else F.lit(True)
            value = F.when(inside, c)
            aggs += [F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
        row = df.agg(*aggs).first()
        still = []
        for i, n in enumerate(open_names):
            lo, hi = row[f"lo{i}"], row[f"hi{i}"]
            if lo is None:
                continue
            seen[n] += 1 if lo == hi else 2
            lows[n], highs[n] = lo, hi
            if lo != hi and seen[n] <= limit:
                still.append(n)
        open_names = still
    return [n for n in names if seen[n] > limit]


def drop_columns(df: DataFrame, names: Sequence[str], strict: bool = True) -> DataFrame:
    """Drop a list, repeated names allowed. Unknown names are an error unless ``strict=False``."""
    unknown = [n for n in dict.fromkeys(names) if n not in df.columns]
    if unknown and strict:
        raise KeyError(f"columns not found: {unknown}")
    gone = set(names)
    return df.select(*[quoted(c) for c in df.columns if c not in gone])


def split_features_label(df: DataFrame, key: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Features (all but the target) and labels, both keyed."""
    features = [c for c in df.columns if c not in (key, target)]
    return (df.select(quoted(key), *[quoted(c) for c in features]), df.select(quoted(key), quoted(target)))


def conform(df: DataFrame, columns: Sequence[str], key: str | None = None, fill_missing=None) -> DataFrame:
    """Exactly the trained columns in trained order. A missing one is an error, or a constant
    column when ``fill_missing`` is given (one-hot values the batch does not contain)."""
    missing = [c for c in columns if c not in df.columns]
    if missing and fill_missing is None:
        raise KeyError(f"columns not found: {missing}")
    out = [quoted(c) if c in df.columns else F.lit(fill_missing).alias(c) for c in columns]
    return df.select(*([quoted(key)] if key else []), *out)


def difference(columns: Sequence[str], minus: Sequence[str]) -> list[str]:
    """Ordered set difference of column names."""
    gone = set(minus)
    return [c for c in columns if c not in gone]


def add_ids(df: DataFrame, natural_key: str, id_colname: str = "patient_id", num_digits: int = 9,
            seed: int = 222) -> DataFrame:
    """Unique anonymous ids of ``num_digits`` digits, the same on every run.

    A seeded hash order of the natural key gives each row a dense rank; the
    multiplier 7**9 shares no factor with 9 * 10**k, so rank -> id is one to one.
    The natural key must be unique. A table with more rows than ids fails.
    """
    size = 9 * 10 ** (num_digits - 1)
    ranked = hashed_rank(df, natural_key, seed, name="__rank")
    spread = F.pmod(F.col("__rank").cast("decimal(38,0)") * F.lit(7 ** 9) + F.lit(seed),
                    F.lit(size).cast("decimal(38,0)")).cast("bigint")
    checked = F.when(F.col("__rank") < size, F.lit(10 ** (num_digits - 1)).cast("bigint") + spread).otherwise(
        F.raise_error(F.lit(f"more rows than {num_digits}-digit ids")).cast("bigint"))
    return ranked.select(checked.alias(id_colname), *[quoted(c) for c in df.columns if c != id_colname])


def _lookup(c: Column, mapping: Mapping) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def replace_values(c: Column, mapping: Mapping) -> Column:
    """Mapped values change, all others stay."""
    return _lookup(c, mapping).otherwise(c) if mapping else c


def map_values(c: Column, mapping: Mapping) -> Column:
    """Mapped values change, all others become missing."""
    return _lookup(c, mapping)


def with_mapped(df: DataFrame, column: str, mapping: Mapping, keep_unmapped: bool) -> DataFrame:
    change: Callable[[Column, Mapping], Column] = replace_values if keep_unmapped else map_values
    return df.withColumn(column, change(quoted(column), mapping))


def fit_one_hot(df: DataFrame, columns: Sequence[str], limit: int = 1000) -> DataFrame:
    """Values to break out, as state rows ``(column_name, value)``. More than ``limit`` values is an error:
    such a column belongs in a long table, not in one column per value."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), quoted(c).cast("string").alias("value")) for c in columns])))
    state = long.filter(F.col("value").isNotNull()).distinct()
    rows = state.limit(limit * len(columns) + 1).collect()
    if len(rows) > limit * len(columns):
        raise ValueError("too many distinct values for one-hot columns")
    rows.sort(key=lambda r: (list(columns).index(r["column_name"]), r["value"]))
    return small_table(df.sparkSession, [(r["column_name"], r["value"]) for r in rows],
                       "column_name string, value string")


def apply_one_hot(df: DataFrame, state: DataFrame) -> DataFrame:
    """Adds ``{column}_{value}`` 0/1 columns; the source stays and a missing value gives all zeros."""
    new = {f"{r['column_name']}_{r['value']}":
           F.coalesce((quoted(r["column_name"]).cast("string") == r["value"]).cast("int"), F.lit(0))
           for r in state.collect()}
    return df.withColumns(new)
