"""Classifiers, cross-validation, calibration, scoring and decision surfaces.

Regressions and support vector machines are margins, linear in the prepared features
or in those of a kernel, and are fitted by :mod:`cohortline.operators.linear`, all
candidates and folds together; forests are grown by Spark ML.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortline.functions.cleaning import numeric_columns, quoted
from cohortline.functions.features import threshold_class
from cohortline.operators.evaluate import ranking_metrics, tuned_thresholds
from cohortline.operators.kernels import LANDMARKS, TOLERANCE, LandmarkMap, PolynomialMap, choose_landmarks, map_of
from cohortline.operators.linear import Candidate, Group, fit_linear, group_of, raw_weights
from cohortline.operators.prep import (
    NumericPrepModel, apply_label_codes, fit_label_codes, fit_numeric_state, standardized)
from cohortline.operators.ranks import sql_name
from cohortline.operators.resample import background_sample, random_oversample, smote, stratified_folds, with_class_weight
from cohortline.operators.scores import ForestScore, LandmarkScore, LinearScore, PolynomialScore, Scaling
from cohortline.session import fresh_path, materialize, small_table

SEED = 222

# Hyperparameter grids by model family.
GRIDS: dict[str, dict[str, list]] = {
    "lr": {"C": [1e-4, 1.0]},
    "rf": {"n_estimators": [10, 50], "max_depth": [None, 10], "min_samples_split": [2, 5]},
    "svm": {
        "kernel": ["linear", "rbf", "poly"],
        "C": np.logspace(-4, 2, 10).tolist(),
        "gamma": [0.001, 0.01, 0.05, 0.1, 0.2, 0.5, "scale", "auto"],
    },
}
BACKGROUND_ROWS = 100  # kept with a tuned model, as what attributions compare with
PREPARED = "__prepared"  # suffix of scaled and imputed copies; the raw columns stay beside them
MAX_TREE_DEPTH = 30  # the deepest tree Spark grows; stands for "no limit"
FOREST_ROWS = 1 << 20  # rows per partition from which a forest is grown
MARGIN = "__margin"


@dataclass(frozen=True)
class Spec:
    """A model family with its hyperparameters; ``sampler`` is None, ``"over"`` or ``"smote"``."""

    family: str
    params: Mapping[str, object] = field(default_factory=dict)
    sampler: str | None = None

    def label(self) -> str:
        return f"{self.family} " + json.dumps(dict(self.params), sort_keys=True)


def grid_specs(family: str, grid: Mapping[str, Sequence] | None = None, sampler: str | None = None) -> list[Spec]:
    """All combinations of a grid, each once. A linear kernel has no gamma."""
    grid = grid or GRIDS[family]
    specs: dict[str, Spec] = {}
    for values in product(*grid.values()):
        params = dict(zip(grid, values))
        if params.get("kernel") == "linear":
            params.pop("gamma", None)
        spec = Spec(family, params, sampler)
        specs.setdefault(spec.label(), spec)
    return list(specs.values())


class MarginModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the decision value of prepared columns; ``payload`` is the fitted function as JSON."""

    inputCols = Param(Params._dummy(), "inputCols", "prepared columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "decision value", TypeConverters.toString)
    payload = Param(Params._dummy(), "payload", "kernel, weights and intercept", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCol: str = MARGIN, payload: str = "{}"):
        super().__init__()
        self._setDefault(inputCols=[], outputCol=MARGIN, payload="{}")
        self._set(**self._input_kwargs)

    @staticmethod
    def of(inputs: Sequence[str], mapping: PolynomialMap | LandmarkMap | None, point: np.ndarray) -> MarginModel:
        payload = (mapping.payload() if mapping else {"kernel": "linear"}) | {"weights": point[:-1].tolist(), "bias": float(point[-1])}
        return MarginModel(inputCols=list(inputs), payload=json.dumps(payload))

    @property
    def fitted(self) -> dict:
        return json.loads(self.getOrDefault("payload"))

    @property
    def coefficients(self) -> np.ndarray:
        return np.array(self.fitted["weights"])

    @property
    def intercept(self) -> float:
        return self.fitted["bias"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        inputs, fitted = self.getOrDefault("inputCols"), self.fitted
        mapping, weights, bias = map_of(fitted), np.array(fitted["weights"]), fitted["bias"]
        if mapping is None:
            margin = F.lit(bias)
            for c, w in zip(inputs, weights.tolist()):
                margin = margin + F.lit(w) * quoted(c)
            return dataset.withColumn(self.getOrDefault("outputCol"), margin)

        @F.pandas_udf("double")
        def value(*columns: pd.Series) -> pd.Series:
            return pd.Series(mapping(np.column_stack([c.to_numpy(float) for c in columns])) @ weights + bias)

        return dataset.withColumn(self.getOrDefault("outputCol"), value(*[quoted(c) for c in inputs]))


def is_margin(spec: Spec) -> bool:
    """Whether the family has a decision value; forests have a probability only."""
    if spec.family not in ("lr", "svm", "rf"):
        raise ValueError(f"unknown model family {spec.family!r}")
    return spec.family != "rf"


def candidate_of(spec: Spec) -> Candidate:
    return Candidate("logistic" if spec.family == "lr" else "hinge", float(spec.params.get("C", 1.0)))


def kernel_of(spec: Spec) -> tuple:
    """What of a spec decides the features that its margin is linear in."""
    p = spec.params
    kernel = p.get("kernel", "linear") if spec.family == "svm" else "linear"
    if kernel == "linear":
        return ("linear",)
    gamma = p.get("gamma", "scale")
    if kernel == "rbf":
        return ("rbf", gamma, int(p.get("landmarks", LANDMARKS)), float(p.get("tolerance", TOLERANCE)))
    if kernel == "poly":
        return ("poly", gamma, float(p.get("coef0", 0.0)), int(p.get("degree", 3)))
    raise ValueError(f"kernel {kernel!r} has no counterpart here")


def kernel_gamma(gamma: float | str, features: int, variance: float) -> float:
    """``"auto"`` is 1 / features, ``"scale"`` is 1 / (features * variance over all prepared cells)."""
    if gamma == "auto":
        return 1.0 / features
    if gamma == "scale":
        return 1.0 / (features * variance) if variance > 0 else 1.0
    return float(gamma)


def fit_margins(rows: DataFrame, label: str, features: Sequence[str], specs: Mapping[str, Spec], groups: Sequence[Group],
                variances: Sequence[float], tag: str | None = None) -> dict[tuple[str, int], tuple]:
    """``(mapping, point)`` of every (spec, group); specs of one kernel are fitted together.

    ``variances`` holds, per group, the variance over all its prepared cells.
    """
    by_kernel: dict[tuple, list[str]] = {}
    for name, spec in specs.items():
        by_kernel.setdefault(kernel_of(spec), []).append(name)
    found = {}
    for kernel, names in by_kernel.items():
        maps = [None] * len(groups)
        if kernel[0] != "linear":
            gammas = [kernel_gamma(kernel[1], len(features), v) for v in variances]
            if kernel[0] == "poly":
                maps = [PolynomialMap(g, *kernel[2:]) for g in gammas]
            else:
                # the same landmarks for all groups, whose preparation differs by little
                first = groups[0]
                scaling = Scaling(np.array(first.low, float), np.array(first.span, float), np.array(first.fill, float))
                landmarks, _ = choose_landmarks(rows, features, scaling, float(np.mean(gammas)), *kernel[2:])
                maps = [LandmarkMap(landmarks, g) for g in gammas]
        fitted = fit_linear(rows, label, features, [replace(g, mapping=m) for g, m in zip(groups, maps)],
                            [candidate_of(specs[n]) for n in names], tag)
        for (g, c), point in fitted.items():
            found[names[c], g] = (maps[g], point)
    return found


def _forest(spec: Spec, label: str, inputs: Sequence[str]) -> list:
    p = dict(spec.params)
    depth = p.get("max_depth")
    return [VectorAssembler(inputCols=list(inputs), outputCol="features"), RandomForestClassifier(
        labelCol=label, numTrees=int(p.get("n_estimators", 10)), maxDepth=MAX_TREE_DEPTH if depth is None else int(depth),
        minInstancesPerNode=max(1, int(p.get("min_samples_split", 2)) // 2), seed=SEED)]


def evenly_dealt(df: DataFrame, rows: int) -> DataFrame:
    """Rows dealt by their content and sorted, into partitions whose number follows from ``rows`` alone.

    Learners that draw rows per partition then grow the same model from the same
    rows, however these came and whatever the session's number of partitions.
    """
    parts = max(8, 1 << (-(-rows // FOREST_ROWS) - 1).bit_length())
    columns = [quoted(c) for c in df.columns]
    return df.repartition(parts, F.xxhash64(*columns)).sortWithinPartitions(*columns)


@contextmanager
def held(df: DataFrame):
    """Cached while in use. Lost blocks are recomputed, so it survives a lost executor."""
    kept = df.persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def fit_platt(df: DataFrame, margin: str, label: str) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through (margin, label)."""
    v = VectorAssembler(inputCols=[margin], outputCol="__m").transform(
        df.select(quoted(margin).cast("double").alias(margin), quoted(label).cast("double").alias(label)))
    fitted = LogisticRegression(featuresCol="__m", labelCol=label, maxIter=100, tol=1e-8).fit(v)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def forest_nodes(model) -> list[list[dict]]:
    """The nodes of each tree of a fitted forest, read from its stored form; ``value`` is the share of class 1."""
    spark = SparkSession.active()
    path = fresh_path(spark, "forest")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, list[dict]] = {}
    for r in rows:
        stats = r["impurityStats"]
        trees.setdefault(r["treeID"], []).append({
            "id": r["id"], "left": r["leftChild"], "right": r["rightChild"], "feature": r["split"]["featureIndex"],
            "threshold": (r["split"]["leftCategoriesOrThreshold"] or [0.0])[0], "value": stats[1] / (sum(stats) or 1.0)})
    return [trees[k] for k in sorted(trees)]


@dataclass
class Classifier:
    """Fitted preparation and model. ``platt`` turns a margin into a probability where the family has none."""

    spec: Spec
    features: list[str]
    stages: PipelineModel
    platt: tuple[float, float] | None = None
    threshold: float = 0.5
    background: list[list[float | None]] | None = None  # feature rows that attributions compare with

    def with_margin(self, df: DataFrame, name: str = "margin") -> DataFrame:
        """Adds the decision value (or the probability, for families that only have one)."""
        return self._scored(df, None, name)

    def score(self, df: DataFrame, name: str = "p") -> DataFrame:
        """Adds the probability of class 1; every input column stays as it is."""
        return self._scored(df, name, None)

    def predict(self, df: DataFrame, threshold: float | None = None) -> DataFrame:
        """Adds ``predictions`` at the stored (or given) threshold and ``predicted_probas``."""
        t = self.threshold if threshold is None else threshold
        out = self.score(df, "predicted_probas")
        return out.withColumn("predictions", threshold_class(F.col("predicted_probas"), t))

    def _scored(self, df: DataFrame, p: str | None, margin: str | None) -> DataFrame:
        forest = self.spec.family == "rf"
        value = vector_to_array("probability")[1] if forest else F.col(MARGIN)
        added = []
        if margin:
            added.append(value.alias(margin))
        if p:
            if self.spec.family == "svm" and not self.platt:
                raise ValueError("the model has no calibration")
            a, b = self.platt or (1.0, 0.0)
            plain = forest and not self.platt
            added.append((value if plain else 1.0 / (1.0 + F.exp(-(F.lit(a) * value + F.lit(b))))).alias(p))
        return self.stages.transform(df).select(*[sql_name(c) for c in df.columns], *added)

    def scaling(self) -> Scaling:
        """The fitted preparation, as arrays."""
        state = {r["column_name"]: r for r in json.loads(self.stages.stages[0].getOrDefault("state"))}
        return Scaling.of([state[c] for c in self.features])

    def linear_score(self) -> LinearScore:
        """The probability as a function of feature arrays, for families that are linear in the features."""
        last = self.stages.stages[-1]
        if self.spec.family == "rf" or kernel_of(self.spec) != ("linear",):
            raise ValueError(f"{self.spec.label()} is not linear in its features")
        if self.spec.family == "svm" and not self.platt:
            raise ValueError("the model has no calibration")
        scaling = self.scaling()
        weights = last.coefficients / scaling.span
        a, b = self.platt or (1.0, 0.0)
        return LinearScore(a * weights, a * (last.intercept - float(weights @ scaling.low)) + b, scaling.fill)

    def array_score(self) -> LinearScore | ForestScore | LandmarkScore | PolynomialScore:
        """The probability as a function of feature arrays, for attributions in place."""
        if self.spec.family == "rf":
            return ForestScore.of_nodes(forest_nodes(self.stages.stages[-1]), self.scaling(), self.platt)
        if kernel_of(self.spec) == ("linear",):
            return self.linear_score()
        if not self.platt:
            raise ValueError("the model has no calibration")
        last, (a, b) = self.stages.stages[-1], self.platt
        mapping, weights, bias = map_of(last.fitted), a * last.coefficients, a * last.intercept + b
        if isinstance(mapping, LandmarkMap):
            return LandmarkScore(self.scaling(), mapping.landmarks, weights, bias, mapping.gamma)
        return PolynomialScore(self.scaling(), mapping, weights, bias)

    def save(self, path: str) -> str:
        self.stages.write().overwrite().save(f"{path}/stages")
        meta = {"family": self.spec.family, "params": dict(self.spec.params), "sampler": self.spec.sampler,
                "features": self.features, "platt": self.platt, "threshold": self.threshold, "background": self.background}
        spark = SparkSession.active()
        small_table(spark, [(json.dumps(meta),)], "meta string").write.mode("overwrite").parquet(
            f"{path}/meta")
        return path

    @staticmethod
    def load(path: str) -> Classifier:
        meta = json.loads(SparkSession.active().read.schema("meta string").parquet(f"{path}/meta").first()["meta"])
        return Classifier(Spec(meta["family"], meta["params"], meta["sampler"]), meta["features"],
                          PipelineModel.load(f"{path}/stages"),
                          tuple(meta["platt"]) if meta["platt"] else None, meta["threshold"], meta.get("background"))


@dataclass
class TrainingSet:
    """Prepared, rebalanced and weighted rows, and the fitted preparation that made them."""

    prep: NumericPrepModel
    rows: DataFrame
    n: int
    features: list[str]
    label: str
    sizes: dict[float, int]

    def group(self, tag: int | None = None) -> Group:
        """The prepared rows as a training group."""
        p = len(self.features)
        return replace(group_of([{"low": 0.0, "high": 1.0, "mean": 0.0}] * p, self.sizes, tag), low=[0.0] * p, span=[1.0] * p)


def label_statistics(df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str] = ()) -> list[dict]:
    """Row count and per feature count, sum, sum of squares, min and max for each (key, label), from one aggregate.

    With the fold as key, every training set's preparation and class sizes follow from these
    few rows, so cross-validation scans the table once for them, not once per fold.
    """
    aggs = [F.expr("count(*) as n")]
    for i, c in enumerate(features):
        x = f"cast({sql_name(c)} as double)"
        aggs += [F.expr(f"{f}({x}) as {a}{i}") for f, a in (("count", "c"), ("sum", "s"), ("min", "a"), ("max", "b"))]
        aggs.append(F.expr(f"sum({x} * {x}) as q{i}"))
    y = quoted(label).cast("double")
    checked = F.when(y.isin(0.0, 1.0), y).otherwise(F.raise_error(F.lit(f"{label} must be 0 or 1")).cast("double"))
    rows = (df.filter(quoted(label).isNotNull()).groupBy(*[quoted(k) for k in keys], checked.alias("__y"))
            .agg(*aggs).collect())
    return [r.asDict() for r in rows]


def combined(stats: Sequence[Mapping], features: Sequence[str]) -> tuple[list[dict], dict[float, int]]:
    """Preparation state and class sizes over several groups of :func:`label_statistics`."""
    state = []
    for i, c in enumerate(features):
        used = [r for r in stats if r[f"c{i}"]]
        state.append({
            "column_name": c, "low": min((r[f"a{i}"] for r in used), default=None),
            "high": max((r[f"b{i}"] for r in used), default=None), "sd": None,
            "mean": sum(r[f"s{i}"] for r in used) / sum(r[f"c{i}"] for r in used) if used else None})
    sizes: dict[float, int] = {}
    for r in sorted(stats, key=lambda r: r["__y"]):
        sizes[r["__y"]] = sizes.get(r["__y"], 0) + r["n"]
    return state, sizes


def cell_variance(stats: Sequence[Mapping], state: Sequence[Mapping]) -> float:
    """Variance over all prepared cells of the groups of :func:`label_statistics`; a missing cell holds its column's mean."""
    n = sum(r["n"] for r in stats)
    total = squares = 0.0
    for i, s in enumerate(state):
        if s["low"] is None:
            continue
        span = (s["high"] - s["low"]) or 1.0
        used = [r for r in stats if r[f"c{i}"]]
        there, sum_, square = (sum(r[f"{k}{i}"] for r in used) for k in "csq")
        away = n - there
        sum_, square = sum_ + away * s["mean"], square + away * s["mean"] ** 2
        total += (sum_ - n * s["low"]) / span
        squares += (square - 2 * s["low"] * sum_ + n * s["low"] ** 2) / span ** 2
    cells = n * len(state)
    return max(0.0, squares / cells - (total / cells) ** 2)


def prepare(df: DataFrame, id_col: str, label: str, features: Sequence[str], sampler: str | None = None,
            stats: Sequence[Mapping] | None = None) -> TrainingSet:
    """Scale and impute, then rebalance: synthetic rows are drawn in the prepared space."""
    features = list(features)
    state, sizes = combined(label_statistics(df, label, features) if stats is None else stats, features)
    train = df.filter(quoted(label).isNotNull()).selectExpr(
        sql_name(id_col), f"cast({sql_name(label)} as double) as {sql_name(label)}", *[sql_name(c) for c in features])
    ready = NumericPrepModel.from_state(features, state).transform(train)
    if sampler == "over":
        ready = random_oversample(ready, id_col, label, SEED, sizes=sizes)
    elif sampler == "smote":
        ready = smote(ready, id_col, label, features, seed=SEED, sizes=sizes)
    elif sampler is not None:
        raise ValueError(f"unknown sampler {sampler!r}")
    if sampler:
        sizes = dict.fromkeys(sizes, max(sizes.values()))
    rows, n = with_class_weight(ready, label, sizes=sizes)
    prep = NumericPrepModel.from_state(features, state, suffix=PREPARED)
    return TrainingSet(prep, rows.selectExpr(sql_name(label), "weight", *[
        f"{sql_name(c)} as {sql_name(c + PREPARED)}" for c in features]), n, features, label, sizes)


def prepared_variances(rows: DataFrame, inputs: Sequence[str], specs: Sequence[Spec], tag: str | None = None) -> dict:
    """Variance over all cells of prepared rows per tag; nothing is read where no kernel asks for it."""
    if not any(kernel_of(s)[1:2] == ("scale",) for s in specs):
        return {}
    n, p = F.count("*") * len(inputs), [quoted(c) for c in inputs]
    mean = sum((F.sum(c) for c in p[1:]), F.sum(p[0])) / n
    square = sum((F.sum(c * c) for c in p[1:]), F.sum(p[0] * p[0])) / n
    found = rows.groupBy(*([tag] if tag else [])).agg((square - mean * mean).alias("v")).collect()
    return {(r[tag] if tag else None): max(0.0, r["v"]) for r in found}


def fit_prepared(data: TrainingSet, spec: Spec) -> Classifier:
    """One candidate on a prepared training set."""
    inputs = [c + PREPARED for c in data.features]
    if is_margin(spec):
        variance = prepared_variances(data.rows, inputs, [spec]).get(None, 0.0)
        mapping, point = fit_margins(data.rows, data.label, inputs, {"one": spec}, [data.group()], [variance])["one", 0]
        fitted: list = [MarginModel.of(inputs, mapping, point)]
    else:
        fitted = Pipeline(stages=_forest(spec, data.label, inputs)).fit(evenly_dealt(data.rows, data.n)).stages
    return Classifier(spec, data.features, PipelineModel(stages=[data.prep, *fitted]))


def fit(df: DataFrame, id_col: str, label: str, features: Sequence[str], spec: Spec, platt_folds: int = 3
        ) -> Classifier:
    """Prepare and fit. Support vector margins get a logistic curve learned on out-of-fold margins, whose models are
    fitted in the same passes."""
    features = list(features)
    if spec.family == "svm" and platt_folds:
        rows, stats = folded(df, id_col, label, features, platt_folds, SEED)
        models = fold_margins(rows, id_col, label, features, {"margin": spec}, platt_folds, stats, whole=True)
        values = materialize(scored_by_fold(rows, features, models, ["margin"], platt_folds, False), "margins")
        return replace(models["margin", platt_folds], platt=fit_platt(values, "margin", label))
    # the learners keep their own compact copy of the rows
    return fit_prepared(prepare(df, id_col, label, features, spec.sampler), spec)


def calibrate(df: DataFrame, id_col: str, label: str, model: Classifier, folds: int = 5) -> Classifier:
    """Platt scaling of the model's decision values, learned on out-of-fold values."""
    values = out_of_fold(df, id_col, label, model.features, {"margin": model.spec}, folds, calibrated=False)
    return replace(model, platt=fit_platt(values, "margin", label))


def folded(df: DataFrame, id_col: str, label: str, features: Sequence[str], folds: int, seed: int) -> tuple[DataFrame, list[dict]]:
    """Rows with a stratified ``fold``, written once, and their statistics per fold."""
    base = df.filter(quoted(label).isNotNull()).select(quoted(id_col), quoted(label), *[quoted(c) for c in features])
    # every fold model and every scored part reads the same small set of columns
    path = fresh_path(df.sparkSession, "folds")
    # and, being partitioned by fold, only the folds it asks for
    stratified_folds(base, id_col, label, folds, seed).write.partitionBy("fold").parquet(path)
    rows = df.sparkSession.read.parquet(path)
    return rows, label_statistics(rows, label, features, ["fold"])


def fold_margins(rows: DataFrame, id_col: str, label: str, features: Sequence[str], specs: Mapping[str, Spec], folds: int,
                 stats: Sequence[Mapping], whole: bool = False) -> dict[tuple[str, int], Classifier]:
    """Margin models of every spec for every fold's training rows; ``rows`` carry ``fold``. With ``whole``, models of all
    rows too, under the number of folds.

    Without a sampler, folds differ by what they leave out, so all are fitted on the rows as they are. Resampled
    training sets are written once, fold by fold under one another.
    """
    parts = range(folds + whole)
    own = [[r for r in stats if r["fold"] != k] for k in parts]
    states = [combined(r, features) for r in own]
    models = {}
    for sampler in dict.fromkeys(s.sampler for s in specs.values()):
        mine = {n: s for n, s in specs.items() if s.sampler == sampler}
        if sampler is None:
            train, inputs, tag = rows, features, "fold"
            groups = [group_of(state, sizes, k, inside=False) for k, (state, sizes) in enumerate(states)]
            variances = [cell_variance(r, state) for r, (state, _) in zip(own, states)]
        else:
            inputs, tag, train, groups = [c + PREPARED for c in features], "__part", None, []
            with ThreadPoolExecutor(8) as pool:  # resampling runs jobs of its own
                sets = list(pool.map(lambda k: prepare(rows.filter(F.col("fold") != k), id_col, label, features, sampler, own[k]), parts))
            for k, data in zip(parts, sets):
                part = data.rows.select("*", F.lit(k).alias(tag))
                train = part if train is None else train.unionByName(part)
                groups.append(data.group(k))
            train = materialize(train, "resampled")
            found = prepared_variances(train, inputs, list(mine.values()), tag)
            variances = [found.get(k, 0.0) for k in parts]
        for (name, k), (mapping, point) in fit_margins(train, label, inputs, mine, groups, variances, tag).items():
            prep = NumericPrepModel.from_state(features, states[k][0], suffix=PREPARED)
            model = MarginModel.of([c + PREPARED for c in features], mapping, point)
            models[name, k] = Classifier(mine[name], list(features), PipelineModel(stages=[prep, model]))
    return models


def scored_by_fold(rows: DataFrame, features: Sequence[str], models: Mapping[tuple[str, int], Classifier], names: Sequence[str],
                   folds: int, calibrated: bool) -> DataFrame:
    """Adds a column per margin spec: the value of the model that left the row's fold out. One projection, whatever the folds."""
    def by_fold(values: Sequence[float]):
        return F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("fold"))

    def curve(value, name: str):
        if not calibrated:
            return value
        platt = [models[name, k].platt or (1.0, 0.0) for k in range(folds)]
        return 1.0 / (1.0 + F.exp(-(by_fold([a for a, _ in platt]) * value + by_fold([b for _, b in platt]))))

    linear = [n for n in names if kernel_of(models[n, 0].spec) == ("linear",)]
    scaling = [models[names[0], k].scaling() for k in range(folds)] if names else []
    added = {}
    for n in linear:
        weights = [models[n, k].stages.stages[-1].coefficients / scaling[k].span for k in range(folds)]
        value = by_fold([models[n, k].stages.stages[-1].intercept - float(w @ scaling[k].low) for k, w in enumerate(weights)])
        for j, c in enumerate(features):
            value = value + by_fold([w[j] for w in weights]) * F.coalesce(quoted(c).cast("double"), by_fold([s.fill[j] for s in scaling]))
        added[n] = curve(value, n)
    out = rows.select("*", *[v.alias(n) for n, v in added.items()])
    mapped = [n for n in names if n not in linear]
    if not mapped:
        return out
    fitted = {(n, k): models[n, k].stages.stages[-1].fitted for n in mapped for k in range(folds)}

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = {key: map_of(f) for key, f in fitted.items()}
        weights = {key: np.array(f["weights"]) for key, f in fitted.items()}
        for batch in batches:
            x = np.column_stack([batch.column(batch.schema.get_field_index(f"__x{j}")).to_numpy(zero_copy_only=False)
                                 for j in range(len(features))]).astype(float)
            fold = batch.column("fold").to_numpy()
            values = {n: np.zeros(len(x)) for n in mapped}
            for k in np.unique(fold):
                at = fold == k
                z = scaling[k](x[at])
                for n in mapped:
                    values[n][at] = maps[n, k](z) @ weights[n, k] + fitted[n, k]["bias"]
            kept = [batch.column(i) for i, f in enumerate(batch.schema.names) if not f.startswith("__x")]
            names_ = [f for f in batch.schema.names if not f.startswith("__x")]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(v) for v in values.values()], names=names_ + list(values))

    wide = out.select("*", *[quoted(c).cast("double").alias(f"__x{j}") for j, c in enumerate(features)])
    schema = ", ".join([f"{sql_name(f.name)} {f.dataType.simpleString()}" for f in out.schema.fields] + [f"{sql_name(n)} double" for n in mapped])
    done = wide.mapInArrow(margins, schema)
    return done.select(*out.columns, *[curve(quoted(n), n).alias(n) for n in mapped])


def fold_forests(rows: DataFrame, id_col: str, label: str, features: Sequence[str], specs: Mapping[str, Spec], folds: int,
                 stats: Sequence[Mapping], parallel: int) -> dict[tuple[str, int], Classifier]:
    """Forests of every spec for every fold; a fold's training rows are prepared once per sampler and shared."""
    samplers = list(dict.fromkeys(s.sampler for s in specs.values()))

    def one(job: tuple[int, str | None]) -> dict[tuple[str, int], Classifier]:
        k, sampler = job
        mine = [(n, s) for n, s in specs.items() if s.sampler == sampler]
        train = rows.filter(F.col("fold") != k)
        data = prepare(train, id_col, label, features, sampler, [r for r in stats if r["fold"] != k])
        with held(data.rows) as kept:
            shared = replace(data, rows=kept)
            return {(name, k): fit_prepared(shared, spec) for name, spec in mine}

    models: dict[tuple[str, int], Classifier] = {}
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        for part in pool.map(one, [(k, s) for k in range(folds) for s in samplers]):
            models.update(part)
    return models


def cross_fitted(df: DataFrame, id_col: str, label: str, features: Sequence[str], specs: Mapping[str, Spec], folds: int,
                 seed: int, parallel: int, calibrated: bool, whole: bool) -> tuple[DataFrame, dict[tuple[str, int], Classifier]]:
    """Out-of-fold scores, and with ``whole`` the margin models of all rows, under the number of folds."""
    features = list(features)
    for spec in specs.values():
        is_margin(spec) and kernel_of(spec)  # an unknown one fails before any work
    rows, stats = folded(df, id_col, label, features, folds, seed)
    margins = {n: s for n, s in specs.items() if is_margin(s)}
    forests = {n: s for n, s in specs.items() if not is_margin(s)}
    models = fold_margins(rows, id_col, label, features, margins, folds, stats, whole) if margins else {}
    bare = {n: s for n, s in margins.items() if s.family == "svm"}
    if calibrated and bare:
        # each fold's curves are learned on out-of-fold margins of its own training rows
        for k in range(folds):
            inner = materialize(out_of_fold(rows.filter(F.col("fold") != k).drop("fold"), id_col, label, features, bare, 3,
                                            calibrated=False), "margins")
            for n in bare:
                models[n, k] = replace(models[n, k], platt=fit_platt(inner, n, label))
    out = scored_by_fold(rows, features, models, list(margins), folds, calibrated)
    if forests:
        grown = fold_forests(rows, id_col, label, features, forests, folds, stats, parallel)
        every, out = out, None
        for k in range(folds):
            part = every.filter(F.col("fold") == k)
            for name in forests:
                part = grown[name, k].score(part, name) if calibrated else grown[name, k].with_margin(part, name)
            out = part if out is None else out.unionByName(part)
    return out.select(quoted(id_col), quoted(label), "fold", *[quoted(n) for n in specs]), models


def out_of_fold(df: DataFrame, id_col: str, label: str, features: Sequence[str], specs: Mapping[str, Spec],
                folds: int = 10, seed: int = SEED, parallel: int = 8, calibrated: bool = True) -> DataFrame:
    """``(id, label, fold, one score column per spec)``: each row scored by models that never saw it.

    Margin specs are fitted together, all candidates and folds in the same passes over the rows, so the number of
    Spark jobs does not grow with either; forests are grown one by one. Only fitting runs jobs; the scores stay lazy.
    ``calibrated=False`` keeps raw decision values, which rank the same.
    """
    return cross_fitted(df, id_col, label, features, specs, folds, seed, parallel, calibrated, False)[0]


def _grid(df: DataFrame, id_col: str, label: str, features: Sequence[str], specs: Sequence[Spec], folds: int, seed: int,
          parallel: int, whole: bool) -> tuple[DataFrame, DataFrame, dict[tuple[str, int], Classifier]]:
    names = {f"c{i}": s for i, s in enumerate(specs)}
    scores, models = cross_fitted(df, id_col, label, features, names, folds, seed, parallel, False, whole)
    # written once: the evaluation, the calibration and the threshold search all read them
    scores = materialize(scores, "scores")
    pairs = {n: (label, n) for n in names}
    per_fold = ranking_metrics(scores, pairs, ["fold"])
    params = F.create_map(*[F.lit(x) for n, s in names.items() for x in (n, s.label())])
    report = per_fold.groupBy("model").agg(
        F.avg("average_precision").alias("mean_score"),
        (2.0 * F.stddev_pop("average_precision")).alias("two_sd")).select(
        F.col("model").alias("candidate"), F.element_at(params, F.col("model")).alias("params"), "mean_score", "two_sd")
    return report, scores, models


def grid_search(df: DataFrame, id_col: str, label: str, features: Sequence[str], specs: Sequence[Spec],
                folds: int = 10, seed: int = SEED, parallel: int = 8) -> tuple[DataFrame, DataFrame]:
    """Average precision of every candidate on every fold.

    Returns the report ``(candidate, params, mean_score, two_sd)`` and the out-of-fold decision values
    with one column ``c{candidate}`` each. All candidates are scored in one evaluation.
    """
    return _grid(df, id_col, label, features, specs, folds, seed, parallel, False)[:2]


def tune(df: DataFrame, id_col: str, label: str, features: Sequence[str], specs: Sequence[Spec],
         folds: int = 10, seed: int = SEED, beta: float = 1.0) -> tuple[Classifier, DataFrame, DataFrame]:
    """Grid search, refit of the best candidate on all rows, threshold from out-of-fold F-beta.

    Returns the model, the report and the out-of-fold probabilities of the best candidate
    ``(id, label, fold, p)``. The out-of-fold decision values calibrate the model, whatever its
    family, and a hashed sample of the rows stays with it as the background of attributions.
    """
    # a margin's model of all rows is fitted in the same passes as those of its folds
    report, scores, models = _grid(df, id_col, label, features, specs, folds, seed, 8, True)
    report = materialize(report, "grid")
    best = report.orderBy(F.desc("mean_score"), "candidate").first()["candidate"]
    spec = specs[int(best[1:])]
    model = models.get((best, folds)) or fit(df, id_col, label, features, spec, platt_folds=0)
    a, b = model.platt = fit_platt(scores, best, label)
    p = 1.0 / (1.0 + F.exp(-(F.lit(a) * quoted(best) + F.lit(b))))
    sample = background_sample(df, id_col, BACKGROUND_ROWS).select(*[quoted(c).cast("double") for c in features])
    model.background = [list(r) for r in sample.collect()]
    oof = scores.select(quoted(id_col), quoted(label), "fold", p.alias("p"))
    model.threshold = float(tuned_thresholds(oof, {"best": (label, "p")}, "fold", [beta]).first()["threshold"])
    return model, report, oof


def decision_surface(df: DataFrame, id_col: str, label: str, pair: Sequence[str], spec: Spec | None = None,
                     points: int = 100) -> DataFrame:
    """Decision value over a grid of two standardized features, ``(i, j, x, y, decision, side, in_margin)``.

    The grid spans each feature from one below its minimum to one above its
    maximum. Text features are label encoded first. The side changes where the
    decision value crosses 0, the margin is the band between -1 and 1.
    """
    spec = spec or Spec("svm", {"kernel": "rbf", "gamma": "auto", "C": 100.0})
    coded = df.select(quoted(id_col), quoted(label), *[quoted(c) for c in pair])
    for c in pair:
        if c not in numeric_columns(df):
            coded = apply_label_codes(coded, c, fit_label_codes(coded, c))
    state = {r["column_name"]: r for r in fit_numeric_state(coded, pair).collect()}
    ready = coded.select(quoted(id_col), quoted(label).cast("double").alias(label), *[
        standardized(quoted(c), state[c]["mean"], state[c]["sd"]).alias(c) for c in pair])
    bounds = [((state[c]["low"] - state[c]["mean"]) / (state[c]["sd"] or 1.0) - 1.0,
               (state[c]["high"] - state[c]["mean"]) / (state[c]["sd"] or 1.0) + 1.0) for c in pair]
    n = ready.count()
    plain = Group([0.0] * 2, [1.0] * 2, [0.0] * 2, (1.0, 1.0), float(n))
    variance = prepared_variances(ready, pair, [spec]).get(None, 0.0)
    mapping, point = fit_margins(ready, label, list(pair), {"one": spec}, [plain], [variance])["one", 0]
    model = MarginModel.of(pair, mapping, point)
    i, j = F.floor(F.col("id") / points).cast("int"), F.pmod(F.col("id"), F.lit(points)).cast("int")
    (x0, x1), (y0, y1) = bounds
    grid = (df.sparkSession.range(points * points).select(i.alias("i"), j.alias("j"))
            .withColumn(pair[0], F.lit(x0) + F.col("i") * F.lit((x1 - x0) / (points - 1)))
            .withColumn(pair[1], F.lit(y0) + F.col("j") * F.lit((y1 - y0) / (points - 1))))
    value = F.col(MARGIN)
    return model.transform(grid).select(
        "i", "j", F.col(f"`{pair[0]}`").alias("x"), F.col(f"`{pair[1]}`").alias("y"), value.alias("decision"),
        (value > 0).cast("int").alias("side"), (F.abs(value) <= 1).cast("int").alias("in_margin"))
