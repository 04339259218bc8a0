"""Run registry as three tables: runs, run_params and run_metrics."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortline.session import small_table

RUNS_SCHEMA = "experiment string, run_id string, run_name string, start_time timestamp"
METRICS_SCHEMA = "run_id string, metric string, value double, step bigint, logged_at timestamp"
PARAMS_SCHEMA = "run_id string, param string, value string, logged_at timestamp"


def _now() -> datetime:
    return datetime.now(timezone.utc)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Most recent run of every (experiment, run_name); equal times go to the larger id."""
    return runs.groupBy("experiment", "run_name").agg(
        F.max_by("run_id", F.struct("start_time", "run_id")).alias("run_id"),
        F.max("start_time").alias("start_time"), F.count("*").alias("n_runs"))


def latest_run(runs: DataFrame, experiment: str, run_name: str, required: bool = False) -> str | None:
    """Id of the most recent run with the name; ``None`` or an error when there is none."""
    row = latest_runs(runs.filter((F.col("experiment") == experiment) & (F.col("run_name") == run_name))).first()
    if row is None and required:
        raise ValueError(f"no run {run_name!r} in experiment {experiment!r}")
    return None if row is None else row["run_id"]


def start_or_resume(spark: SparkSession, path: str, experiment: str, run_name: str) -> str:
    """Id of the latest run with the name, or of a new run appended to the registry.

    A new run's id follows from its names, so writers that start one run at the same time claim the same id; the row
    that was written first is the run (:func:`read_table`).
    """
    found = latest_run(read_table(spark, path, "runs"), experiment, run_name)
    if found is not None:
        return found
    run_id = uuid.uuid5(uuid.NAMESPACE_OID, f"{len(experiment)}:{experiment}{run_name}").hex
    row = [(experiment, run_id, run_name, _now())]
    _append(small_table(spark, row, RUNS_SCHEMA), path, "runs")
    return run_id


def _append(rows: DataFrame, path: str, name: str) -> None:
    """Every write has a folder of its own, so writers at the same time do not touch each other's files."""
    rows.write.parquet(f"{path}/{name}/{uuid.uuid4().hex}")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One registry table; empty before its first write. Of the rows that claim one run id the earliest counts."""
    schema = {"runs": RUNS_SCHEMA, "run_metrics": METRICS_SCHEMA, "run_params": PARAMS_SCHEMA}[name]
    try:
        rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/{name}")
        if name != "runs":
            return rows
        first = rows.groupBy("run_id").agg(F.min(F.struct("start_time", "experiment", "run_name")).alias("r"))
        return first.select("r.experiment", "run_id", "r.run_name", "r.start_time")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return small_table(spark, [], schema)


def latest_values(logged: DataFrame, name: str) -> DataFrame:
    """The value logged last for every run and ``name`` (``metric`` or ``param``): latest time, then step, then value."""
    order = F.struct("logged_at", *(["step"] if "step" in logged.columns else []), "value")
    return logged.groupBy("run_id", name).agg(F.max_by("value", order).alias("value"))


def metric_rows(values: DataFrame, at: datetime | Column, step: int | Column = 0) -> DataFrame:
    """``(run_id, metric, value)`` with the time and step they are logged at."""
    def column(x):
        return x if isinstance(x, Column) else F.lit(x)

    return values.select("run_id", "metric", F.col("value").cast("double").alias("value"), column(step).cast("bigint").alias("step"),
                         column(at).cast("timestamp").alias("logged_at"))


def append_metrics(values: DataFrame, path: str, at: datetime | Column, step: int | Column = 0) -> None:
    """Append many metrics at once, from a table ``(run_id, metric, value)``."""
    _append(metric_rows(values, at, step), path, "run_metrics")


def log_metrics(spark: SparkSession, path: str, run_id: str, metrics: Mapping[str, float] | None, step: int = 0) -> int:
    """Append one row per metric as a double, with time and step; nothing is written for no metrics."""
    rows = [(run_id, k, float(v)) for k, v in (metrics or {}).items()]
    if rows:
        append_metrics(small_table(spark, rows, "run_id string, metric string, value double"), path, _now(), step)
    return len(rows)


def log_params(spark: SparkSession, path: str, run_id: str, params: Mapping[str, object] | None) -> int:
    rows = [(run_id, k, str(v), _now()) for k, v in (params or {}).items()]
    if rows:
        _append(small_table(spark, rows, PARAMS_SCHEMA), path, "run_params")
    return len(rows)


def rank_key(mode: str):
    """Order of runs by ``value`` for ``max`` or ``min``; later runs first on equal values."""
    if mode not in ("max", "min"):
        raise ValueError("mode must be 'max' or 'min'")
    return [F.desc_nulls_last("value") if mode == "max" else F.asc_nulls_last("value"),
            F.desc("start_time"), F.desc("run_id")]


def best_run_table(runs: DataFrame, metrics: DataFrame, experiment: str, metric: str, mode: str = "max") -> DataFrame:
    """The best run of an experiment as a one-row table with its estimator (run name up to the first ``_``).

    A run that was logged again counts with its latest value.
    """
    wanted = latest_values(metrics.filter(F.col("metric") == metric), "metric").select("run_id", "value")
    return (runs.filter(F.col("experiment") == experiment).join(wanted, "run_id", "left")
            .orderBy(*rank_key(mode)).limit(1)
            .select("experiment", "run_id", "run_name", F.split("run_name", "_")[0].alias("estimator"), "value"))


def find_best_model(runs: DataFrame, metrics: DataFrame, experiment: str, metric: str, mode: str = "max"
                    ) -> tuple[str, str]:
    """Run name and estimator name of the best run. An unknown or empty experiment is an error."""
    row = best_run_table(runs, metrics, experiment, metric, mode).first()
    if row is None:
        raise ValueError(f"no runs found for experiment {experiment!r}")
    return row["run_name"], row["estimator"]
