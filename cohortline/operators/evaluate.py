"""Evaluation of scores against binary labels.

Every function takes ``pairs``: a map from a model name to its (label, score)
columns, so several outcomes or models of one wide table are handled at once.
``keys`` (a fold, for example) split the result further.

Curves come from counts per distinct score and bucketed running totals
(:mod:`cohortline.operators.ranks`): no window ever covers a whole table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortline.functions.cleaning import quoted
from cohortline.functions.features import half_even
from cohortline.operators.ranks import order_splits, running_totals, sql_name, sql_text, with_buckets

Pairs = Mapping[str, tuple[str, str]]


def stack_scores(df: DataFrame, pairs: Pairs, keys: Sequence[str] = (), extra: Mapping[str, Sequence] | None = None
                 ) -> DataFrame:
    """Long form ``(*keys, model, y, p)`` without rows that lack label or score."""
    structs = []
    for i, (m, (y, p)) in enumerate(pairs.items()):
        parts = [f"{sql_text(m)} as model", f"cast({sql_name(y)} as int) as y", f"cast({sql_name(p)} as double) as p"]
        parts += [f"{sql_name(cols[i])} as {sql_name(a)}" for a, cols in (extra or {}).items()]
        structs.append(f"struct({', '.join(parts)})")
    long = df.selectExpr(*[sql_name(k) for k in keys], f"inline(array({', '.join(structs)}))")
    return long.filter("y is not null and p is not null and not isnan(p)")


def score_table(df: DataFrame, pairs: Pairs, keys: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score with its own and its cumulative class counts, from the highest score down.

    ``(*keys, model, score, pos, neg, pos_run, neg_run, pos_all, neg_all)``
    """
    scores = list(dict.fromkeys(p for _, p in pairs.values()))
    wide = df.select(*[quoted(c) for c in dict.fromkeys([*keys, *[y for y, _ in pairs.values()]])
                       if c not in scores], *[quoted(s).cast("double").alias(s) for s in scores])
    bucketed = with_buckets(wide, order_splits(wide, scores))
    long = stack_scores(bucketed, pairs, keys, {"bucket": [p + "__bucket" for _, p in pairs.values()]})
    classes = [F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")]
    points = long.groupBy(*keys, "model", "bucket", F.col("p").alias("score")).agg(*classes)
    # from the points, so that the source is read once for both
    totals = points.groupBy(*keys, "model", "bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return running_totals(points, totals, [*keys, "model"], "bucket", "score", ["pos", "neg"]).drop("bucket")


def _precision(pos: Column, neg: Column) -> Column:
    return F.try_divide(pos.cast("double"), (pos + neg).cast("double"))


def _rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def _with_end(points: DataFrame, keys: Sequence[str], point: Column, end: Mapping[str, float]) -> DataFrame:
    """One row per point; the highest score of each curve also brings the end point, which has no threshold."""
    highest = (F.col("pos_run") == F.col("pos")) & (F.col("neg_run") == F.col("neg"))
    last = F.struct(F.lit(None).cast("double").alias("threshold"), *[F.lit(v).alias(c) for c, v in end.items()])
    return points.select(*keys, "model", F.inline(F.when(highest, F.array(last, point)).otherwise(F.array(point))))


def roc_curve(df: DataFrame, pairs: Pairs, keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, model, threshold, fpr, tpr)``, one point per distinct score.

    The starting point (0, 0) has a missing threshold: it lies above every score.
    """
    point = F.struct(F.col("score").alias("threshold"), _rate(F.col("neg_run"), F.col("neg_all")).alias("fpr"),
                     _rate(F.col("pos_run"), F.col("pos_all")).alias("tpr"))
    return _with_end(score_table(df, pairs, keys), keys, point, {"fpr": 0.0, "tpr": 0.0})


def pr_curve(df: DataFrame, pairs: Pairs, keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, model, threshold, precision, recall)``; the end point (recall 0, precision 1) has no threshold."""
    point = F.struct(F.col("score").alias("threshold"), _precision(F.col("pos_run"), F.col("neg_run")).alias("precision"),
                     _rate(F.col("pos_run"), F.col("pos_all")).alias("recall"))
    return _with_end(score_table(df, pairs, keys), keys, point, {"precision": 1.0, "recall": 0.0})


def ranking_metrics(df: DataFrame, pairs: Pairs, keys: Sequence[str] = ()) -> DataFrame:
    """ROC area, step average precision and trapezoid precision-recall area, ``(*keys, model, ...)``.

    Previous points follow from the running totals minus the row's own counts, so no lag is needed.
    """
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    up, out = F.col("pos_run").cast("double"), F.col("neg_run").cast("double")
    here = _precision(F.col("pos_run"), F.col("neg_run"))
    before = F.coalesce(_precision(F.col("pos_run") - F.col("pos"), F.col("neg_run") - F.col("neg")), F.lit(1.0))
    sums = score_table(df, pairs, keys).groupBy(*keys, "model").agg(
        F.sum(neg * (up + up - pos) / 2.0).alias("roc"),
        F.sum(pos * here).alias("step"),
        F.sum(pos * (here + before) / 2.0).alias("trapezoid"),
        F.max("pos_all").alias("positives"), F.max("neg_all").alias("negatives"))
    p, n = F.col("positives").cast("double"), F.col("negatives").cast("double")
    return sums.select(*keys, "model", "positives", "negatives",
                       F.try_divide(F.col("roc"), p * n).alias("roc_auc"),
                       F.try_divide(F.col("step"), p).alias("average_precision"),
                       F.try_divide(F.col("trapezoid"), p).alias("pr_auc"))


def metrics_by_threshold(df: DataFrame, pairs: Pairs, thresholds: Mapping[str, float] | float = 0.5,
                         keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and specificity at every distinct score, with the model's own threshold alongside."""
    precision = _precision(F.col("pos_run"), F.col("neg_run"))
    recall = _rate(F.col("pos_run"), F.col("pos_all"))
    return score_table(df, pairs, keys).select(
        *keys, "model", F.col("score").alias("threshold"), precision.alias("precision"), recall.alias("recall"),
        (2.0 * precision * recall / (precision + recall + F.lit(1e-9))).alias("f1"),
        (F.lit(1.0) - _rate(F.col("neg_run"), F.col("neg_all"))).alias("specificity"),
        _threshold(pairs, thresholds).alias("model_threshold"))


def _threshold(pairs: Pairs, thresholds: Mapping[str, float] | float) -> Column:
    if not isinstance(thresholds, Mapping):
        return F.lit(float(thresholds))
    out = None
    for m in pairs:
        hit, value = F.col("model") == m, F.lit(float(thresholds[m]))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def _with_cells(long: DataFrame, pairs: Pairs, thresholds) -> DataFrame:
    called = F.col("p") > _threshold(pairs, thresholds)
    return long.select("*", ((F.col("y") == 1) & called).alias("tp"), ((F.col("y") == 1) & ~called).alias("fn"),
                       ((F.col("y") == 0) & called).alias("fp"), ((F.col("y") == 0) & ~called).alias("tn"))


def confusion_counts(df: DataFrame, pairs: Pairs, thresholds: Mapping[str, float] | float = 0.5,
                     keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, model, tp, fn, fp, tn)`` with predictions strictly above the threshold; one aggregate, no sort."""
    long = _with_cells(stack_scores(df, pairs, keys), pairs, thresholds)
    return long.groupBy(*keys, "model").agg(*[F.count_if(c).alias(c) for c in ("tp", "fn", "fp", "tn")])


def confusion_matrix(df: DataFrame, pairs: Pairs, thresholds: Mapping[str, float] | float = 0.5,
                     normalize: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, model, actual, predicted, value)``: counts, or shares by ``true``, ``pred`` or ``all``."""
    c = confusion_counts(df, pairs, thresholds, keys)
    cells = {(1, 1): "tp", (1, 0): "fn", (0, 1): "fp", (0, 0): "tn"}
    if normalize not in (None, "true", "pred", "all"):
        raise ValueError("normalize must be None, 'true', 'pred' or 'all'")

    def value(actual: int, predicted: int) -> Column:
        own = F.col(cells[actual, predicted])
        if normalize is None:
            return own.cast("double")
        scope = [n for (a, p), n in cells.items()
                 if normalize == "all" or (normalize == "true" and a == actual) or (normalize == "pred" and p == predicted)]
        return F.coalesce(_rate(own, sum((F.col(n) for n in scope[1:]), F.col(scope[0]))), F.lit(0.0))

    return c.select(*keys, "model", F.inline(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), value(a, p).alias("value"))
        for a, p in cells])))


def calibration_curve(df: DataFrame, pairs: Pairs, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Mean score and share of positives in uniform bins closed on the right; empty bins do not appear."""
    position = F.greatest(F.ceil(F.col("p") * bins) - 1, F.lit(0)).cast("int")
    return (stack_scores(df, pairs, keys).groupBy(*keys, "model", position.alias("bin"))
            .agg(F.count("*").alias("n"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("fraction_positive")))


def brier_score(df: DataFrame, pairs: Pairs, keys: Sequence[str] = ()) -> DataFrame:
    gap = F.col("p") - F.col("y")
    return stack_scores(df, pairs, keys).groupBy(*keys, "model").agg(F.avg(gap * gap).alias("brier"))


def classification_report(df: DataFrame, pairs: Pairs, thresholds: Mapping[str, float] | float = 0.5,
                          keys: Sequence[str] = ()) -> DataFrame:
    """Rows ``0``, ``1``, ``accuracy``, ``macro avg`` and ``weighted avg`` with precision, recall, f1 and support."""
    c = confusion_counts(df, pairs, thresholds, keys)
    tp, fn, fp, tn = (F.col(x).cast("double") for x in ("tp", "fn", "fp", "tn"))
    zero = F.lit(0.0)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), zero)

    by_class = {
        "0": (ratio(tn, tn + fn), ratio(tn, tn + fp), ratio(2 * tn, 2 * tn + fn + fp), tn + fp),
        "1": (ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fn + fp), tp + fn),
    }
    total = tp + fn + fp + tn
    accuracy = ratio(tp + tn, total)
    macro = [(a + b) / 2.0 for a, b in zip(by_class["0"][:3], by_class["1"][:3])]
    weighted = [ratio(a * by_class["0"][3] + b * by_class["1"][3], total)
                for a, b in zip(by_class["0"][:3], by_class["1"][:3])]
    rows = {**{k: v for k, v in by_class.items()}, "accuracy": (accuracy, accuracy, accuracy, total),
            "macro avg": (*macro, total), "weighted avg": (*weighted, total)}
    return c.select(*keys, "model", F.inline(F.array(*[
        F.struct(F.lit(name).alias("label"), v[0].alias("precision"), v[1].alias("recall"), v[2].alias("f1"),
                 v[3].cast("bigint").alias("support")) for name, v in rows.items()])))


def pooled_metrics(df: DataFrame, pairs: Pairs, thresholds: Mapping[str, float] | float = 0.5) -> DataFrame:
    """Counts over all folds and the rates that follow from them; one aggregate."""
    return confusion_counts(df, pairs, thresholds).select(
        "model", "tp", "fn", "fp", "tn", _precision(F.col("tp"), F.col("fp")).alias("precision"),
        _precision(F.col("tp"), F.col("fn")).alias("sensitivity"), _precision(F.col("tn"), F.col("fp")).alias("specificity"))


def headline_metrics(df: DataFrame, pairs: Pairs, thresholds: Mapping[str, float] | float = 0.5,
                     keys: Sequence[str] = ()) -> DataFrame:
    """One row per model: precision, average precision, sensitivity, specificity, ROC area and Brier score.

    With several models this is the model summary table; over pooled out-of-fold
    scores it is the cross-validated summary; with ``keys=["fold"]`` it is per fold.
    """
    gap = F.col("p") - F.col("y")
    long = _with_cells(stack_scores(df, pairs, keys), pairs, thresholds)
    cells = long.groupBy(*keys, "model").agg(
        *[F.count_if(c).alias(c) for c in ("tp", "fn", "fp", "tn")], F.avg(gap * gap).alias("brier"))
    ranks = ranking_metrics(df, pairs, keys)
    return cells.join(ranks, [*keys, "model"]).select(
        *keys, "model", "tp", "fn", "fp", "tn",
        _precision(F.col("tp"), F.col("fp")).alias("precision"), "average_precision",
        _precision(F.col("tp"), F.col("fn")).alias("sensitivity"),
        _precision(F.col("tn"), F.col("fp")).alias("specificity"), "roc_auc", "brier",
        _threshold(pairs, thresholds).alias("model_threshold"))


# Display names of the headline metrics.
METRIC_NAMES = {
    "precision": "Precision/PPV",
    "average_precision": "Average Precision",
    "sensitivity": "Sensitivity",
    "specificity": "Specificity",
    "roc_auc": "AUC ROC",
    "brier": "Brier Score",
}


def metric_frame(metrics: DataFrame, input_name: str, keys: Sequence[str] = ("model",), digits: int = 3) -> DataFrame:
    """Headline metrics in long form, named ``"{input} {metric}"`` and rounded: ``(*keys, metric, value)``."""
    return metrics.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(f"{input_name} {label}").alias("metric"), half_even(F.col(c), digits).alias("value"))
        for c, label in METRIC_NAMES.items()])))


def concat_metrics(frames: Mapping[str, DataFrame], digits: int = 3) -> DataFrame:
    """Metric frames ``(metric, value)`` of several inputs under one another, prefixed with the input name."""
    out = None
    for name, f in frames.items():
        part = f.select(F.concat_ws(" ", F.lit(name), "metric").alias("metric"),
                        half_even(F.col("value"), digits).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def fbeta_thresholds(df: DataFrame, pairs: Pairs, betas: Sequence[float] = (1.0, 2.0), keys: Sequence[str] = (),
                     grid: int = 1000) -> DataFrame:
    """Threshold that maximizes F-beta on a 1/grid raster, ``(*keys, model, beta, threshold, fbeta)``.

    Scores are first counted per raster cell, which bounds the window to ``grid``
    rows. Among equal values the lowest threshold is taken; where all scores are 0 it is 0.
    """
    floor = F.floor(F.col("p") * grid)
    # raster thresholds strictly below the score: p > i / grid for i < cell
    cell = (floor + (F.col("p") > floor / F.lit(float(grid))).cast("int")).cast("int")
    counts = (stack_scores(df, pairs, keys).groupBy(*keys, "model", cell.alias("cell"))
              .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    per_model = W.partitionBy(*keys, "model")
    down = per_model.orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, 0)
    runs = (counts.withColumn("tp", F.sum("pos").over(down)).withColumn("fp", F.sum("neg").over(down))
            .withColumn("all_pos", F.sum("pos").over(per_model))
            .withColumn("at", F.coalesce(F.lag("cell").over(per_model.orderBy("cell")), F.lit(0)))
            .withColumn("top", F.max("cell").over(per_model))
            .filter("cell > 0 OR top = 0"))

    def fbeta(b: float) -> Column:
        w = float(b) * float(b)
        # no score is above the lowest threshold where all are 0
        called = F.col("cell") > 0
        tp, fp = F.when(called, F.col("tp")).otherwise(0), F.when(called, F.col("fp")).otherwise(0)
        return F.try_divide((1 + w) * tp, F.lit(w) * F.col("all_pos") + tp + fp)

    long = runs.select(*keys, "model", F.when(F.col("cell") > 0, F.col("at")).otherwise(0).alias("at"), F.inline(F.array(*[
        F.struct(F.lit(float(b)).alias("beta"), fbeta(b).alias("f")) for b in betas])))
    best = long.groupBy(*keys, "model", "beta").agg(
        F.max_by(F.struct("at", "f"), F.struct(F.coalesce("f", F.lit(-1.0)), -F.col("at"))).alias("b"))
    return best.select(*keys, "model", "beta", (F.col("b.at") / F.lit(float(grid))).alias("threshold"),
                       F.col("b.f").alias("fbeta"))


def tuned_thresholds(df: DataFrame, pairs: Pairs, fold: str, betas: Sequence[float] = (1.0, 2.0)) -> DataFrame:
    """Fold thresholds averaged per model: ``(model, beta, threshold)``."""
    return (fbeta_thresholds(df, pairs, betas, [fold]).groupBy("model", "beta")
            .agg(F.avg("threshold").alias("threshold")))
