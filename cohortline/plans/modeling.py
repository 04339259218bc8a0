"""Train, register, pick, score and explain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortline.operators import explain, registry
from cohortline.operators.evaluate import METRIC_NAMES, headline_metrics
from cohortline.operators.models import Classifier, grid_specs, out_of_fold, tune
from cohortline.operators.resample import background_sample, choose_split
from cohortline.session import small_table

SAMPLERS: dict[str, str | None] = {"orig": None, "smote": "smote", "over": "over"}


def train_and_register(df: DataFrame, id_col: str, label: str, features: Sequence[str], registry_path: str,
                       families: Sequence[str] = ("lr", "rf", "svm"), samplers: Sequence[str] = ("orig", "smote", "over"),
                       grids: Mapping[str, Mapping[str, Sequence]] | None = None, folds: int = 10) -> DataFrame:
    """Tune every family under every sampler, store model, parameters and pooled out-of-fold metrics.

    Returns ``(run_name, metric, value)`` of the new runs.
    """
    spark = df.sparkSession
    experiment = f"{label}_model"
    rows = []
    for family in families:
        for sampling in samplers:
            specs = grid_specs(family, (grids or {}).get(family), SAMPLERS[sampling])
            model, _, oof = tune(df, id_col, label, features, specs, folds)
            run_name = f"{family}_{sampling}_training"
            run_id = registry.start_or_resume(spark, registry_path, experiment, run_name)
            found = headline_metrics(oof, {family: (label, "p")}, model.threshold).first()
            metrics = {f"K-Fold {title}": found[c] for c, title in METRIC_NAMES.items()}
            registry.log_metrics(spark, registry_path, run_id, metrics)
            registry.log_params(spark, registry_path, run_id, {**model.spec.params, "threshold": model.threshold})
            model.save(f"{registry_path}/models/{run_id}")
            rows += [(run_name, k, float(v)) for k, v in metrics.items()]
    return small_table(spark, rows, "run_name string, metric string, value double")


def evaluate_registered(df: DataFrame, id_col: str, label: str, registry_path: str, run_id: str, folds: int = 10) -> DataFrame:
    """Recompute a registered model's K-fold metrics over ``df`` and log them to its run: ``(run_id, metric, value)``."""
    spark = df.sparkSession
    model = Classifier.load(f"{registry_path}/models/{run_id}")
    oof = out_of_fold(df, id_col, label, model.features, {"m": model.spec}, folds, calibrated=False)
    if model.platt:
        a, b = model.platt
        oof = oof.withColumn("m", 1.0 / (1.0 + F.exp(-(F.lit(a) * F.col("m") + F.lit(b)))))
    found = headline_metrics(oof, {model.spec.family: (label, "m")}, model.threshold).first()
    metrics = {f"K-Fold {title}": found[c] for c, title in METRIC_NAMES.items()}
    registry.log_metrics(spark, registry_path, run_id, metrics)
    return small_table(spark, [(run_id, k, float(v)) for k, v in metrics.items()], "run_id string, metric string, value double")


def load_best(spark: SparkSession, registry_path: str, label: str, metric: str = "K-Fold Average Precision",
              mode: str = "max") -> Classifier:
    """The best registered model of an outcome."""
    best = registry.best_run_table(registry.read_table(spark, registry_path, "runs"),
                                   registry.read_table(spark, registry_path, "run_metrics"),
                                   f"{label}_model", metric, mode).first()
    if best is None:
        raise ValueError(f"no runs found for experiment '{label}_model'")
    return Classifier.load(f"{registry_path}/models/{best['run_id']}")


def predict_rows(df: DataFrame, id_col: str, model: Classifier) -> DataFrame:
    """``(id, predictions, predicted_probas)``; works on a batch and on a stream."""
    return model.predict(df).select(id_col, "predictions", "predicted_probas")


def explain_rows(df: DataFrame, id_col: str, model: Classifier, top: int = 3, background_rows: int = 100,
                 label: str | None = None, with_values: bool = True, scores: DataFrame | None = None,
                 permutations: int | None = None, split: str | None = None, shares: Mapping[str, float] | None = None
                 ) -> DataFrame:
    """Explanation table of every row. Rows and background pass through the same fitted preparation.

    The background is the one stored with the model, so a row's attribution does not
    depend on its batch; a model without one takes ``background_rows`` of the batch.
    ``scores`` may bring out-of-fold probabilities ``(id[, label], p)``; otherwise the model
    scores the rows. ``split`` explains one named part of a stratified split by ``shares``.
    Attributions are exact unless ``permutations`` are asked for, and made in place for every family.
    """
    if split is not None:
        df = choose_split(df, id_col, label, split, shares or {"train": 0.8, "test": 0.2})
    background = model.background or background_sample(df, id_col, background_rows)
    long = explain.shapley(df, id_col, model.features, background, model.array_score(), permutations)
    wide = explain.attribution_wide(long, id_col, model.features)
    if scores is None:
        scores = model.score(df, "p").select(id_col, *([label] if label else []), F.col("p"))
    return explain.explanation_table(wide, scores, id_col, model.features, top, "p", label, model.threshold, with_values)
