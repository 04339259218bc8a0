"""Text cleaning and casting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortline.session import small_table

# A cell holding a run of two or more of these anywhere counts as missing.
DASH_RUN = "--"
DOT_RUN = ".."

# Spellings of numbers and of missing numbers, compared in lower case.
NUMBER_CHARACTERS = "0123456789+-.eE"
INFINITE = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")
NOT_A_NUMBER = ("nan", "+nan", "-nan")

def quoted(name: str) -> Column:
    """Column by exact name, whatever characters the header holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def null_tokens(c: Column) -> Column:
    """Empty text and cells containing a run of dashes or dots become NULL."""
    return F.when((c != "") & ~c.contains(DASH_RUN) & ~c.contains(DOT_RUN), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing floating-point values arrive as NaN from some sources; here missing is NULL."""
    return df.select(*[
        F.nullif(quoted(f.name), F.lit(float("nan")).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else quoted(f.name)
        for f in df.schema.fields
    ])


def missing_text(c: Column) -> Column:
    """Empty text and NaN count as missing."""
    return (c == "") | F.lower(F.trim(c)).isin(*NOT_A_NUMBER)


def _spelled(c: Column) -> Column:
    """Only characters of decimal numbers. Checked before any cast: it is cheaper than a failing one, and
    the cast alone would also take "12d" and hexadecimal text."""
    return (F.trim(c) != "") & (F.translate(F.trim(c), NUMBER_CHARACTERS, "") == "")


def to_number(c: Column) -> Column:
    """Number in a text cell (infinities included, NaN not), else NULL."""
    return F.when(_spelled(c) | F.lower(F.trim(c)).isin(*INFINITE), c.try_cast("double"))


def number_kind(c: Column) -> Column:
    """0 missing, 1 integer, 2 other number, 3 no number."""
    return (F.when(c.isNull() | missing_text(c), 0)
            .when(_spelled(c), F.when(c.try_cast("bigint").isNotNull(), 1)
                  .when(c.try_cast("double").isNotNull(), 2).otherwise(3))
            .when(F.lower(F.trim(c)).isin(*INFINITE), 2).otherwise(3))


def thousands_to_number(c: Column) -> Column:
    """Number written with thousand separators, else NULL."""
    return to_number(F.replace(c, F.lit(","), F.lit("")))


def coerce_number(c: Column) -> Column:
    """Any column to double; what does not parse becomes NULL."""
    return to_number(c.cast("string"))


def fit_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Which text columns hold numbers only: state rows ``(column_name, target_type)``.

    One aggregate over all candidate columns. A column qualifies when every
    non-missing cell parses; it becomes BIGINT when all cells are present and
    integral, DOUBLE otherwise. A column without any value stays as it is.
    """
    names = list(columns) if columns is not None else string_columns(df)
    schema = "column_name string, target_type string"
    if not names:
        return small_table(df.sparkSession, [], schema)
    kinds = df.select(*[number_kind(quoted(n)).alias(f"k{i}") for i, n in enumerate(names)])
    row = kinds.agg(*[f(f"k{i}").alias(f"{t}{i}") for i in range(len(names)) for f, t in ((F.min, "lo"), (F.max, "hi"))]
                    ).first()
    state = [(n, "bigint" if row[f"lo{i}"] == row[f"hi{i}"] == 1 else "double")
             for i, n in enumerate(names) if row[f"hi{i}"] in (1, 2)]
    return small_table(df.sparkSession, state, schema)


def apply_numeric(df: DataFrame, state: DataFrame) -> DataFrame:
    """Cast the columns :func:`fit_numeric` found; all others pass through."""
    targets = {r["column_name"]: r["target_type"] for r in state.collect()}
    out = []
    for n in df.columns:
        c = quoted(n)
        if targets.get(n) == "bigint":
            out.append(F.trim(c).try_cast("bigint").alias(n))
        elif n in targets:
            out.append(to_number(c).alias(n))
        else:
            out.append(c)
    return df.select(*out)


def safe_to_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Whole-column numeric inference: fit and apply in one step."""
    return apply_numeric(df, fit_numeric(df, columns))


def normalize_null_tokens(df: DataFrame) -> DataFrame:
    texts = set(string_columns(df))
    return df.select(*[null_tokens(quoted(n)).alias(n) if n in texts else quoted(n) for n in df.columns])


def clean_dataframe(df: DataFrame, cols_with_thousand_separators: Sequence[str] = ()) -> DataFrame:
    """Null tokens, then separator columns to numbers, then inference on the remaining text columns."""
    df = normalize_null_tokens(df)
    separated = [c for c in cols_with_thousand_separators if c in df.columns]
    texts = set(string_columns(df))
    df = df.select(*[
        (thousands_to_number(quoted(n)) if n in texts else quoted(n).cast("double")).alias(n)
        if n in separated else quoted(n)
        for n in df.columns
    ])
    return safe_to_numeric(df, [c for c in string_columns(df) if c not in separated])


def handle_missing_values(df: DataFrame, columns: Sequence[str], fillna_value=None) -> DataFrame:
    """Fill the chosen columns; without a value nothing changes. A value of another type is an error."""
    if fillna_value is None:
        return df
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise KeyError(f"columns not found: {unknown}")
    wanted = T.StringType if isinstance(fillna_value, str) else (
        T.BooleanType if isinstance(fillna_value, bool) else T.NumericType)
    mismatched = [c for c in columns if not isinstance(df.schema[c].dataType, wanted)]
    if mismatched:
        raise TypeError(f"fill value {fillna_value!r} does not fit columns {mismatched}")
    return df.na.fill(fillna_value, subset=list(columns))


def placeholder(c: Column, mark: str = "-") -> Column:
    """Text for display, with a mark in place of missing values."""
    return F.coalesce(c.cast("string"), F.lit(mark))
