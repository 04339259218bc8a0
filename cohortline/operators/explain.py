"""Attribution of scores to features, and its rendering.

Scores over feature arrays (:mod:`cohortline.operators.scores`) are explained where
the rows lie; no row is multiplied. :func:`kernel_shap` is for scores that need a
DataFrame, and refuses what would multiply rows too often.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohortline.functions.cleaning import quoted
from cohortline.functions.features import confusion_flags, half_even, threshold_class
from cohortline.operators.ranks import sql_name, unpivot
from cohortline.operators.scores import CELLS_AT_ONCE, LinearScore  # noqa: F401
from cohortline.session import bucket_count

MAX_EXACT_FEATURES = 20  # 2**20 coalitions; beyond, permutations must be asked for
MAX_BACKGROUND_ROWS = 1000
MAX_COPIES = 1 << 18  # of a row, for scores that need a DataFrame
ROWS_AT_ONCE = 256


def coalition_plan(p: int, permutations: int | None = None, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions as rows of booleans and the weight of each one's value in each feature's attribution.

    All subsets with their Shapley weights; with ``permutations``, the prefixes of so
    many seeded permutations. Either way the attributions sum to f(x) - f(background).
    """
    if permutations is None:
        if p > MAX_EXACT_FEATURES:
            raise ValueError(f"{p} features have too many coalitions: ask for permutations")
        masks = (np.arange(1 << p)[:, None] >> np.arange(p) & 1).astype(bool)
        size = masks.sum(axis=1)
        inside = np.array([0.0] + [factorial(s - 1) * factorial(p - s) / factorial(p) for s in range(1, p + 1)])
        outside = np.array([-factorial(s) * factorial(p - s - 1) / factorial(p) for s in range(p)] + [0.0])
        return masks, np.where(masks, inside[size][:, None], outside[size][:, None]).T
    rng = np.random.default_rng(seed)
    terms: dict[bytes, np.ndarray] = {}
    for _ in range(permutations):
        mask = np.zeros(p, bool)
        for j in rng.permutation(p):
            terms.setdefault(mask.tobytes(), np.zeros(p))[j] -= 1.0 / permutations
            mask = mask.copy()
            mask[j] = True
            terms.setdefault(mask.tobytes(), np.zeros(p))[j] += 1.0 / permutations
    keys = sorted(terms)
    return np.array([np.frombuffer(k, bool) for k in keys]), np.stack([terms[k] for k in keys], axis=1)


def coalition_slices(p: int, step: int, permutations: int | None = None, seed: int = 42) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows and weights of :func:`coalition_plan`, so many at once: subsets are counted through, never held together."""
    if permutations is not None:
        masks, weights = coalition_plan(p, permutations, seed)
        for at in range(0, len(masks), step):
            yield masks[at:at + step], weights[:, at:at + step]
        return
    if p > MAX_EXACT_FEATURES:
        raise ValueError(f"{p} features have too many coalitions: ask for permutations")
    inside = np.array([0.0] + [factorial(s - 1) * factorial(p - s) / factorial(p) for s in range(1, p + 1)])
    outside = np.array([-factorial(s) * factorial(p - s - 1) / factorial(p) for s in range(p)] + [0.0])
    for at in range(0, 1 << p, step):
        masks = (np.arange(at, min(1 << p, at + step))[:, None] >> np.arange(p) & 1).astype(bool)
        size = masks.sum(axis=1)
        yield masks, np.where(masks, inside[size][:, None], outside[size][:, None]).T


def attributions(score: Callable[[np.ndarray], np.ndarray], rows: np.ndarray, background: np.ndarray,
                 permutations: int | None = None, seed: int = 42) -> np.ndarray:
    """Shapley values of a score over arrays, one row each, in slices of bounded size."""
    if permutations is None and hasattr(score, "attributions"):
        return score.attributions(rows, background)
    p = rows.shape[1]
    phi = np.zeros(rows.shape)
    step = max(1, CELLS_AT_ONCE // max(len(rows), len(background), 1))
    for masks, weights in coalition_slices(p, step, permutations, seed):
        if hasattr(score, "coalition_values"):
            values = score.coalition_values(rows, background, masks)
        else:
            values = coalition_values(score, rows, background, masks)
        phi += values @ weights.T
    return phi


def coalition_values(self, rows: np.ndarray, background: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Mean score of each row under each coalition: the row's own part and the background's add up."""
        own = np.where(np.isnan(rows), self.fill, rows) * self.weights
        other = np.where(np.isnan(background), self.fill, background) * self.weights
        step = max(1, CELLS_AT_ONCE // len(background))
        out = np.empty((len(rows), len(masks)))
        for at in range(0, len(masks), step):
            part = masks[at:at + step]
            rest = ~part @ other.T + self.bias
            for i, mine in enumerate(own @ part.T):
                out[i, at:at + step] = (1.0 / (1.0 + np.exp(-(rest + mine[:, None])))).mean(axis=1)
        return out


def coalition_values(score: Callable[[np.ndarray], np.ndarray], rows: np.ndarray, background: np.ndarray, masks: np.ndarray
                     ) -> np.ndarray:
    """Mean score of each row under each coalition, for any score over feature arrays."""
    step = max(1, CELLS_AT_ONCE // background.size)
    out = np.empty((len(rows), len(masks)))
    for i, x in enumerate(rows):
        for at in range(0, len(masks), step):
            mixed = np.where(masks[at:at + step, None, :], x, background)
            out[i, at:at + step] = score(mixed.reshape(-1, mixed.shape[-1])).reshape(-1, len(background)).mean(axis=1)
    return out


def background_rows(background: DataFrame | Sequence[Sequence], features: Sequence[str]) -> np.ndarray:
    if isinstance(background, DataFrame):
        background = background.select(*[quoted(c).cast("double") for c in features]).limit(MAX_BACKGROUND_ROWS + 1).collect()
    if not background or len(background) > MAX_BACKGROUND_ROWS:
        raise ValueError(f"the background must have 1 to {MAX_BACKGROUND_ROWS} rows")
    return np.array([[np.nan if v is None else v for v in r] for r in background], np.float64)


def shapley(df: DataFrame, id_col: str, features: Sequence[str], background: DataFrame | Sequence[Sequence],
            score: Callable[[np.ndarray], np.ndarray], permutations: int | None = None, seed: int = 42) -> DataFrame:
    """Shapley attributions of a score over feature arrays, in long form ``(id, feature, phi)``.

    No row is multiplied. A row takes milliseconds, so rows are dealt over all
    tasks first, whatever files they come from. Exact unless ``permutations`` are
    asked for.
    """
    features = list(features)
    if permutations is None and len(features) > MAX_EXACT_FEATURES and not getattr(score, "additive", False):
        raise ValueError(f"{len(features)} features have too many coalitions: ask for permutations")
    other = background_rows(background, features)
    spark = df.sparkSession
    id_type = df.select(quoted(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[at:at + ROWS_AT_ONCE]
                phi = attributions(score, part[names].to_numpy(dtype="float64"), other, permutations, seed)
                yield pd.DataFrame({id_col: np.repeat(part[id_col].to_numpy(), len(features)),
                                    "feature": np.tile(np.array(features, object), len(part)), "phi": phi.ravel()})

    names = [f"__f{i}" for i in range(len(features))]
    wide = df.select(quoted(id_col), *[quoted(c).cast("double").alias(n) for c, n in zip(features, names)])
    dealt = wide.repartition(bucket_count(spark, spark.sparkContext.defaultParallelism), quoted(id_col))
    return dealt.mapInPandas(run, f"{sql_name(id_col)} {id_type}, feature string, phi double")


def kernel_shap(df: DataFrame, id_col: str, features: Sequence[str], background: DataFrame | Sequence[Sequence],
                score: Callable[[DataFrame], DataFrame], permutations: int | None = None, seed: int = 42) -> DataFrame:
    """Shapley attributions of a score that needs a DataFrame, in long form ``(id, feature, phi)``.

    ``score`` adds a column ``p`` to a frame with the feature columns: any model
    or expression. Each row is expanded over coalitions and background rows where
    it lies; the weighted sums combine there too, so one row per id is shuffled.
    Cost per row is coalitions x background rows: :func:`shapley` is the better way
    for a score that is a function of arrays, ``permutations`` for many features.
    """
    features = list(features)
    if len(features) > 62:
        raise ValueError("a coalition of more than 62 features does not fit a mask")
    other = background_rows(background, features)
    p = len(features)
    if (1 << p if permutations is None else permutations * p + 1) * len(other) > MAX_COPIES:
        raise ValueError(f"a row would be copied more than {MAX_COPIES} times: use shapley, fewer features or permutations")
    masks, weights = coalition_plan(p, permutations, seed)
    codes = [int(sum(1 << int(j) for j in np.flatnonzero(m))) for m in masks]
    b = len(other)
    mask_of = F.array(*[F.lit(m).cast("bigint") for m in codes])
    wide = df.select(quoted(id_col), *[quoted(c).cast("double").alias(c) for c in features]).withColumn(
        "__k", F.explode(F.sequence(F.lit(0), F.lit(len(masks) * b - 1))))
    wide = (wide.withColumn("__m", F.floor(F.col("__k") / b).cast("int"))
            .withColumn("__b", F.pmod(F.col("__k"), F.lit(b)).cast("int"))
            .withColumn("__mask", F.get(mask_of, F.col("__m"))))
    mixed = wide.select(quoted(id_col), "__m", *[
        F.when(F.col("__mask").bitwiseAND(F.lit(1 << j).cast("bigint")) != 0, quoted(c))
        .otherwise(F.get(F.array(*[F.lit(None if np.isnan(r[j]) else float(r[j])).cast("double") for r in other]), F.col("__b"))).alias(c)
        for j, c in enumerate(features)])
    scored = score(mixed)
    sums = scored.groupBy(quoted(id_col)).agg(*[
        F.sum(F.col("p") * F.get(F.array(*[F.lit(float(w) / b) for w in weights[j]]), F.col("__m"))).alias(f"phi{j}")
        for j in range(len(features))])
    return sums.select(quoted(id_col), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"phi{j}").alias("phi")) for j, c in enumerate(features)])))


def linear_attribution(df: DataFrame, id_col: str, coefficients: Mapping[str, float], means: Mapping[str, float]
                       ) -> DataFrame:
    """Margin-space attribution of a linear model, ``w * (x - mean)``: column arithmetic only."""
    return df.select(quoted(id_col), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.lit(float(w)) * (quoted(c) - F.lit(float(means[c])))).alias("phi"))
        for c, w in coefficients.items()])))


def attribution_wide(long: DataFrame, id_col: str, features: Sequence[str]) -> DataFrame:
    """One attribution column per feature, keyed by row id."""
    return long.groupBy(quoted(id_col)).agg(*[
        F.max(F.when(F.col("feature") == c, F.col("phi"))).alias(c) for c in features])


def global_importance(long: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    return long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance")).orderBy(F.desc("importance"), "feature")


def attribution_values(long: DataFrame, df: DataFrame, id_col: str, features: Sequence[str]) -> DataFrame:
    """Attribution next to the feature value: ``(id, feature, phi, value)``."""
    values = unpivot(df, [id_col], features, "feature", "value", cast="double")
    return long.join(values, [id_col, "feature"])


def top_features(columns: Sequence[str], n: int, digits: int = 2) -> Column:
    """The ``n`` columns largest in rounded absolute value, as an ordered array of (name, value);
    the earlier column wins a tie, missing values are left out. Row-local."""
    parts = F.array(*[
        F.struct((-half_even(F.abs(quoted(c)), digits)).alias("order"), F.lit(i).alias("position"),
                 F.lit(c).alias("name")) for i, c in enumerate(columns)])
    ordered = F.slice(F.array_sort(F.filter(parts, lambda s: s["order"].isNotNull())), 1, n)
    return F.transform(ordered, lambda s: F.struct(s["name"].alias("name"), (-s["order"] + 0.0).alias("value")))


def top_map(columns: Sequence[str], n: int) -> Column:
    return F.map_from_entries(top_features(columns, n))


def top_names(columns: Sequence[str], n: int) -> Column:
    """Names only, joined by a comma."""
    return F.array_join(F.transform(top_features(columns, n), lambda s: s["name"]), ", ")


def top_json(columns: Sequence[str], n: int) -> Column:
    """JSON text, encoded once."""
    return F.to_json(top_map(columns, n))


def explanation_table(wide: DataFrame, scores: DataFrame, id_col: str, features: Sequence[str], n: int,
                      probability: str, label: str | None = None, threshold: float = 0.5,
                      with_values: bool = True) -> DataFrame:
    """Id, top features, probability, prediction and, with labels, the four confusion flags."""
    name = f"Top {n} Features"
    shown = wide.select(quoted(id_col), (top_json if with_values else top_names)(features, n).alias(name))
    p = quoted(probability)
    predicted = threshold_class(p, threshold)
    columns = [quoted(id_col), p.alias("y_pred_proba"), predicted.alias("y_pred")]
    if label:
        columns += [c.alias(k) for k, c in confusion_flags(quoted(label), predicted).items()]
    return shown.join(scores.select(*columns), id_col)
