"""Reading and writing tables, fitted column lists and named-table collections."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cohortline.functions.cleaning import nan_to_null, quoted
from cohortline.session import small_table

LISTS_SCHEMA = "list_name string, position int, column_name string"


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table with NaN read as missing. Only the named columns reach the scan."""
    df = spark.read.parquet(path)
    if columns is not None:
        df = df.select(*[quoted(c) for c in columns])
    return nan_to_null(df)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str, key: str | None = None) -> DataFrame:
    """CSV by header with a declared schema; ``key`` must then be present and unique."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return assert_key(df, key) if key else df


def assert_key(df: DataFrame, key: str) -> DataFrame:
    """Fail when the key has missing or repeated values."""
    repeated = df.groupBy(quoted(key)).agg(F.count("*").alias("n")).filter(quoted(key).isNull() | (F.col("n") > 1))
    bad = repeated.limit(1).collect()
    if bad:
        raise ValueError(f"{key} is not a key: value {bad[0][0]!r} occurs {bad[0][1]} times")
    return df


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> str:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with header; map, array and struct columns become JSON text first."""
    nested = (T.MapType, T.ArrayType, T.StructType)
    flat = df.select(*[
        F.to_json(quoted(f.name)).alias(f.name) if isinstance(f.dataType, nested) else quoted(f.name)
        for f in df.schema.fields
    ])
    flat.write.mode(mode).option("header", True).csv(path)
    return path


def write_outputs(df: DataFrame, outputs: Mapping[str, Callable[[DataFrame], DataFrame]],
                  mode: str = "overwrite") -> list[str]:
    """Several parquet outputs of one parent, which is computed once and kept while they are written.

    Kept blocks that go with an executor are computed again; no copy of the parent is written.
    """
    kept = df.persist()
    try:
        return [write_parquet(build(kept), path, mode) for path, build in outputs.items()]
    finally:
        kept.unpersist()


def lists_to_state(spark: SparkSession, lists: Mapping[str, Iterable[str]]) -> DataFrame:
    """Fitted column lists as a table; repeated names are kept once, order is kept."""
    rows = [(name, i, c) for name, cols in lists.items() for i, c in enumerate(dict.fromkeys(cols))]
    return small_table(spark, rows, LISTS_SCHEMA)


def state_to_lists(state: DataFrame) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in state.orderBy("list_name", "position").collect():
        out.setdefault(r["list_name"], []).append(r["column_name"])
    return out


def save_lists(spark: SparkSession, lists: Mapping[str, Iterable[str]], path: str) -> str:
    return write_parquet(lists_to_state(spark, lists).coalesce(1), path)


def load_lists(spark: SparkSession, path: str) -> dict[str, list[str]]:
    return state_to_lists(spark.read.schema(LISTS_SCHEMA).parquet(path))


def save_tables(tables: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A long collection with a ``table_name`` column, one folder per table."""
    return write_parquet(tables, path, mode, ["table_name"])


def load_tables(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("table_name").isin(*names)) if names else df


def merge_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two collections; a table named in both comes from ``right``."""
    taken = right.select("table_name").distinct()
    return left.join(taken, "table_name", "left_anti").unionByName(right, allowMissingColumns=True)
