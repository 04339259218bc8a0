"""Raw clinical rows to model-ready features: fit on a training table, replay on any later one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortline.functions import cleaning, features as fx
from cohortline.operators.cohort import minimum_filter
from cohortline.operators.columns import (
    CLINICAL_NAMES, apply_one_hot, columns_matching, conform, drop_columns, fit_one_hot, rename_columns, with_mapped)
from cohortline.operators.describe import low_variance_columns
from cohortline.sources.files import lists_to_state, load_lists, save_lists, write_parquet

# Thresholds, spellings and column roles of the clinical table.
ADULT_AGE = 18
LOW_VARIANCE = 0.02
TARGET = "Bleeding_Edema_Outcome"
ORIGIN_SPELLING = {"Marocco": "Morocco"}
ONE_HOT = ("Anesthesia_Type", "BMI_Category")
OUTCOME_PARTS = (
    "Functional_Outcomes_Bleeding",
    "Functional_Outcomes_Edema",
    "Functional_Outcomes_Pain",
    "Functional_Outcomes_Infection",
)
REDUNDANT = (
    "ID",
    "Weight_kg",
    "Cost_of_Procedure_euros",
    "Birthday",
    "BMI_Category_Normal_Weight",
    "Preop_DBP",
    "Anesthesia_Type_lidocaine",
    "Anesthesia_Type_carbocaine",
    "Intraop_MAP",
    "Comorbidity_Flag",
)


@dataclass
class ClinicalState:
    """Everything learned from the training table, as tables."""

    numeric: DataFrame
    one_hot: DataFrame
    lists: dict[str, list[str]]

    def save(self, path: str) -> str:
        write_parquet(self.numeric.coalesce(1), f"{path}/numeric")
        write_parquet(self.one_hot.coalesce(1), f"{path}/one_hot")
        save_lists(self.numeric.sparkSession, self.lists, f"{path}/lists")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> ClinicalState:
        return ClinicalState(spark.read.parquet(f"{path}/numeric"), spark.read.parquet(f"{path}/one_hot"),
                             load_lists(spark, f"{path}/lists"))

    def frame(self) -> DataFrame:
        return lists_to_state(self.numeric.sparkSession, self.lists)


def normalize(raw: DataFrame) -> DataFrame:
    """Names and spellings."""
    return with_mapped(rename_columns(raw, CLINICAL_NAMES), "Geographical_Origin", ORIGIN_SPELLING, True)


def derive(df: DataFrame) -> DataFrame:
    """Body mass index, pressures, flags and the adult filter. All row-local: the filter reaches the scan."""
    df = fx.calculate_bmi(df, "Weight_kg", "Height_m")
    df = fx.calculate_bmi_category(df)
    df = fx.calculate_map(df, "Preop_MAP", combined_bp_col="Preop_Blood_Pressure_mmHg", on_error="null")
    df = fx.calculate_map(df, "Intraop_MAP", combined_bp_col="Intraop_Mean_Blood_Pressure_mmHg", on_error="null")
    df = fx.split_bp_column(df, "Intraop_Mean_Blood_Pressure_mmHg", "Intraop_SBP", "Intraop_DBP")
    df = fx.split_bp_column(df, "Preop_Blood_Pressure_mmHg", "Preop_SBP", "Preop_DBP")
    df = df.withColumns({
        "Comorbidity_Flag": fx.presence_flag(F.col("Comorbidities")),
        "Surgical_Technique": fx.binary_encode(F.col("Surgical_Technique"), "Traditional"),
        "Diabetes": fx.mention_flag(F.col("Comorbidities").cast("string"), "DM"),
        "Comorbidities": cleaning.coerce_number(F.col("Comorbidities")),
    })
    return minimum_filter(df, "Age_years", ADULT_AGE)


def _expanded(raw: DataFrame, state_numeric: DataFrame, state_one_hot: DataFrame) -> DataFrame:
    return apply_one_hot(derive(cleaning.apply_numeric(normalize(raw), state_numeric)), state_one_hot)


def fit_clinical(raw: DataFrame, key: str = "patient_id", target: str = TARGET,
                 threshold: float = LOW_VARIANCE) -> ClinicalState:
    """Learn types, one-hot values and column lists.

    Three small aggregates over the table: text inference, one-hot values and
    variances. The sources of the outcome are kept whatever their variance.
    """
    named = normalize(raw)
    strings = [c for c in cleaning.string_columns(named)]
    numeric = cleaning.fit_numeric(named, [c for c in strings if c != "Comorbidities"])
    typed = cleaning.apply_numeric(named, numeric)
    values = fit_one_hot(fx.calculate_bmi_category(fx.calculate_bmi(typed, "Weight_kg", "Height_m")), ONE_HOT)
    full = apply_one_hot(derive(typed), values)
    checked = [c for c in cleaning.numeric_columns(full) if c not in (key, *OUTCOME_PARTS)]
    low = low_variance_columns(full, threshold, checked)
    left = drop_columns(full, low)
    redundant = [c for c in [*REDUNDANT, *columns_matching(left, contains="Preop_")] if c in left.columns and c != key]
    functional = [c for c in columns_matching(left, contains="Functional") if target not in c]
    gone = {*redundant, *functional, key}
    x = [c for c in cleaning.numeric_columns(left) if c not in gone]
    lists = {"string_cols": strings, "low_variance": low, "cols_to_drop": redundant,
             "functional_cols": functional, "X_columns": x}
    return ClinicalState(numeric, values, lists)


def apply_clinical(raw: DataFrame, state: ClinicalState, key: str = "patient_id", target: str | None = TARGET
                   ) -> DataFrame:
    """Trained features of any table with the raw columns, plus the outcome when asked for.
    A one-hot value the table lacks is a column of zeros."""
    full = _expanded(raw, state.numeric, state.one_hot)
    if target is None:
        return conform(full, state.lists["X_columns"], key)
    outcome = fx.any_flag(*[F.col(c) for c in OUTCOME_PARTS]).alias(target)
    return conform(full.withColumn(target, outcome), [*state.lists["X_columns"], target], key)


def exploratory(raw: DataFrame, state: ClinicalState) -> DataFrame:
    """The cohort with all derived columns, for description; only low-variance columns are gone."""
    return drop_columns(_expanded(raw, state.numeric, state.one_hot), state.lists["low_variance"], strict=False)


def write_cohort(raw: DataFrame, state: ClinicalState, eda_path: str, model_path: str, key: str = "patient_id",
                 target: str = TARGET) -> list[str]:
    """Exploratory and model-ready copies; the raw table is read once."""
    write_parquet(exploratory(raw, state), eda_path)
    # every model column is in the exploratory copy, so the second pass reads those few columns of it
    described = raw.sparkSession.read.parquet(eda_path)
    outcome = fx.any_flag(*[F.col(c) for c in OUTCOME_PARTS]).alias(target)
    write_parquet(described.select(key, *[cleaning.quoted(c) for c in state.lists["X_columns"]], outcome), model_path)
    return [eda_path, model_path]


def feature_names(state: ClinicalState, categorical: Sequence[str] = ()) -> list[str]:
    """Numeric model columns: all trained columns but the categorical ones."""
    return [c for c in state.lists["X_columns"] if c not in set(categorical)]
