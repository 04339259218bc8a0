"""Queries on score evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.operators import evaluate as ev
from cohortline.plans import views as v
from cohortline.plans.catalog import query, r, rounded

PAIRS = {"signal": ("y", "signal"), "noise": ("y", "noise")}
DENSE = {"dense": ("y", "p")}


def curve_sql(base: str, models: dict[str, str], keys: str = "") -> str:
    """Cumulative counts per distinct score, highest first, as the CTE ``curve``."""
    stacked = " UNION ALL ".join(f"SELECT '{m}' AS model, {keys}y, {p} AS s FROM {base}" for m, p in models.items())
    over = f"OVER (PARTITION BY model{', ' + keys.rstrip(', ') if keys else ''}"
    return f"""long AS ({stacked}), points AS (
  SELECT model, {keys}s, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM long GROUP BY ALL), curve AS (
  SELECT *, (sum(pos) {over} ORDER BY s DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS tp,
    (sum(neg) {over} ORDER BY s DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS fp,
    (sum(pos) {over}))::BIGINT AS np, (sum(neg) {over}))::BIGINT AS nn FROM points)"""


_MODELS = {"signal": "signal", "noise": "noise"}
_TWO = f"WITH {v.SCORED}, {curve_sql('scored', _MODELS)}"
_ONE = f"WITH {v.DENSE}, {curve_sql('dense', {'dense': 'p'})}"


def _roc(base: str) -> str:
    return f"""{base} SELECT model, s AS threshold, {r('fp / nn')} AS fpr, {r('tp / np')} AS tpr FROM curve
UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 0e0, 0e0 FROM curve"""


@query("roc_curve", _roc(_TWO))
def _(t):
    return rounded(ev.roc_curve(v.scored(t), PAIRS), "fpr", "tpr")


@query("roc_curve_of_dense_scores", _roc(_ONE))
def _(t):
    return rounded(ev.roc_curve(v.dense(t), DENSE), "fpr", "tpr")


@query("precision_recall_curve", f"""{_TWO} SELECT model, s AS threshold, {r('tp / (tp + fp)')} AS precision,
  {r('tp / np')} AS recall FROM curve UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 1e0, 0e0 FROM curve""")
def _(t):
    return rounded(ev.pr_curve(v.scored(t), PAIRS), "precision", "recall")


_RANKING = f"""SELECT model, {{0}}max(np) AS positives, max(nn) AS negatives,
  {r('sum(neg * (2 * tp - pos) / 2e0) / (max(np)::DOUBLE * max(nn))')} AS roc_auc,
  {r('sum(pos * (tp / (tp + fp))) / max(np)')} AS average_precision,
  {r('sum(pos * (tp / (tp + fp) + CASE WHEN tp + fp = pos + neg THEN 1e0 ELSE (tp - pos) / (tp + fp - pos - neg) END) / 2) / max(np)')}
    AS pr_auc FROM curve GROUP BY ALL"""


@query("ranking_metrics", f"{_TWO} {_RANKING.format('')}")
def _(t):
    return rounded(ev.ranking_metrics(v.scored(t), PAIRS), "roc_auc", "average_precision", "pr_auc")


@query("ranking_metrics_of_dense_scores", f"{_ONE} {_RANKING.format('')}")
def _(t):
    return rounded(ev.ranking_metrics(v.dense(t), DENSE), "roc_auc", "average_precision", "pr_auc")


@query("ranking_metrics_by_fold", f"WITH {v.SCORED}, {curve_sql('scored', _MODELS, 'fold, ')} {_RANKING.format('fold, ')}")
def _(t):
    return rounded(ev.ranking_metrics(v.scored(t), PAIRS, ["fold"]), "roc_auc", "average_precision", "pr_auc")


@query("metrics_by_threshold", f"""{_TWO} SELECT model, s AS threshold, {r('tp / (tp + fp)')} AS precision,
  {r('tp / np')} AS recall, {r('2 * (tp / (tp + fp)) * (tp / np) / (tp / (tp + fp) + tp / np + 1e-9)')} AS f1,
  {r('1 - fp / nn')} AS specificity, CASE model WHEN 'signal' THEN 0.478e0 ELSE 0.5e0 END AS model_threshold FROM curve""")
def _(t):
    d = ev.metrics_by_threshold(v.scored(t), PAIRS, {"signal": 0.478, "noise": 0.5})
    return rounded(d, "precision", "recall", "f1", "specificity")


_THRESHOLDS = {"signal": 0.478, "noise": 0.5}
_CELLS_SQL = f"""WITH {v.SCORED}, long AS (
  SELECT fold, 'signal' AS model, y, signal AS p, signal > 0.478e0 AS c FROM scored UNION ALL
  SELECT fold, 'noise', y, noise, noise > 0.5e0 FROM scored), cells AS (
  SELECT model, {{0}}count(*) FILTER (y = 1 AND c) AS tp, count(*) FILTER (y = 1 AND NOT c) AS fn, count(*) FILTER (y = 0 AND c) AS fp,
    count(*) FILTER (y = 0 AND NOT c) AS tn, avg(pow(p - y, 2)) AS brier FROM long GROUP BY ALL)"""
_CELLS = _CELLS_SQL.format("")


@query("confusion_counts", f"{_CELLS} SELECT model, tp, fn, fp, tn FROM cells")
def _(t):
    return ev.confusion_counts(v.scored(t), PAIRS, _THRESHOLDS)


def _matrix_sql(tp: str, fn: str, fp: str, tn: str) -> str:
    return f"""{_CELLS} SELECT model, 1 AS actual, 1 AS predicted, {r(tp)} AS value FROM cells
UNION ALL SELECT model, 1, 0, {r(fn)} FROM cells UNION ALL SELECT model, 0, 1, {r(fp)} FROM cells
UNION ALL SELECT model, 0, 0, {r(tn)} FROM cells"""


for _norm, _sql in {
    None: _matrix_sql("tp", "fn", "fp", "tn"),
    "true": _matrix_sql("tp / (tp + fn)", "fn / (tp + fn)", "fp / (fp + tn)", "tn / (fp + tn)"),
    "pred": _matrix_sql("tp / (tp + fp)", "fn / (fn + tn)", "fp / (tp + fp)", "tn / (fn + tn)"),
    "all": _matrix_sql(*[f"{c} / (tp + fn + fp + tn)" for c in ("tp", "fn", "fp", "tn")]),
}.items():
    @query("confusion_matrix" + (f"_by_{_norm}" if _norm else ""), _sql)
    def _(t, norm=_norm):
        return rounded(ev.confusion_matrix(v.scored(t), PAIRS, _THRESHOLDS, norm), "value")


@query("calibration_curve", f"""WITH {v.SCORED}, long AS (SELECT 'signal' AS model, y, signal AS p FROM scored
  UNION ALL SELECT 'noise', y, noise FROM scored)
SELECT model, greatest(ceil(p * 10) - 1, 0)::INT AS bin, count(*) AS n, {r('avg(p)')} AS mean_predicted,
  {r('avg(y)')} AS fraction_positive FROM long GROUP BY ALL""")
def _(t):
    return rounded(ev.calibration_curve(v.scored(t), PAIRS), "mean_predicted", "fraction_positive")


@query("brier_score", f"{_CELLS} SELECT model, {r('brier')} AS brier FROM cells")
def _(t):
    return rounded(ev.brier_score(v.scored(t), PAIRS), "brier")


_P0, _R0, _F0 = "tn / (tn + fn)", "tn / (tn + fp)", "2 * tn / (2 * tn + fn + fp)"
_P1, _R1, _F1 = "tp / (tp + fp)", "tp / (tp + fn)", "2 * tp / (2 * tp + fn + fp)"
_N = "(tp + fn + fp + tn)"


def _weighted(a: str, b: str) -> str:
    return f"(({a}) * (tn + fp) + ({b}) * (tp + fn)) / {_N}"


def _report_row(label: str, p: str, q: str, f: str, n: str) -> str:
    return f"SELECT model, '{label}' AS label, {r(p)} AS precision, {r(q)} AS recall, {r(f)} AS f1, {n}::BIGINT AS support FROM cells"


@query("classification_report", _CELLS + " " + " UNION ALL ".join([
    _report_row("0", _P0, _R0, _F0, "(tn + fp)"), _report_row("1", _P1, _R1, _F1, "(tp + fn)"),
    _report_row("accuracy", *[f"(tp + tn) / {_N}"] * 3, _N),
    _report_row("macro avg", *[f"(({a}) + ({b})) / 2" for a, b in ((_P0, _P1), (_R0, _R1), (_F0, _F1))], _N),
    _report_row("weighted avg", *[_weighted(a, b) for a, b in ((_P0, _P1), (_R0, _R1), (_F0, _F1))], _N)]))
def _(t):
    return rounded(ev.classification_report(v.scored(t), PAIRS, _THRESHOLDS), "precision", "recall", "f1")


_HEADLINE = ("precision", "average_precision", "sensitivity", "specificity", "roc_auc", "brier")


def _headline_sql(keys: str = "") -> str:
    using = "model" + (", " + keys.rstrip(", ") if keys else "")
    cells = _CELLS_SQL.format(keys).removeprefix(f"WITH {v.SCORED}, long").replace("cells AS", "cells AS", 1)
    curve = curve_sql("scored", _MODELS, keys).replace("long AS", "stacked AS", 1).replace("FROM long", "FROM stacked", 1)
    return f"""WITH {v.SCORED}, long{cells}, {curve}, ranks AS (
  SELECT model, {keys}sum(neg * (2 * tp - pos) / 2e0) / (max(np)::DOUBLE * max(nn)) AS auc,
    sum(pos * (tp / (tp + fp))) / max(np) AS ap FROM curve GROUP BY ALL)
SELECT model, {keys}tp, fn, fp, tn, {r('tp / (tp + fp)')} AS precision, {r('ap')} AS average_precision,
  {r('tp / (tp + fn)')} AS sensitivity, {r('tn / (tn + fp)')} AS specificity, {r('auc')} AS roc_auc,
  {r('brier')} AS brier, CASE model WHEN 'signal' THEN 0.478e0 ELSE 0.5e0 END AS model_threshold
FROM cells JOIN ranks USING ({using})"""


@query("model_summary", _headline_sql())
def _(t):
    return rounded(ev.headline_metrics(v.scored(t), PAIRS, _THRESHOLDS), *_HEADLINE)


@query("metrics_per_fold", _headline_sql("fold, "))
def _(t):
    return rounded(ev.headline_metrics(v.scored(t), PAIRS, _THRESHOLDS, ["fold"]), *_HEADLINE)


@query("pooled_fold_metrics", f"""{_CELLS_SQL.format('fold, ')}, pooled AS (
  SELECT model, sum(tp)::BIGINT AS tp, sum(fn)::BIGINT AS fn, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn
  FROM cells GROUP BY 1) SELECT model, tp, fn, fp, tn, {r('tp / (tp + fp)')} AS precision,
  {r('tp / (tp + fn)')} AS sensitivity, {r('tn / (tn + fp)')} AS specificity FROM pooled""")
def _(t):
    return rounded(ev.pooled_metrics(v.scored(t), PAIRS, _THRESHOLDS), "precision", "sensitivity", "specificity")


@query("metric_frame", "WITH h AS (" + _headline_sql() + ") " + " UNION ALL ".join(
    f"SELECT model, 'K-Fold {title}' AS metric, {r(c, 3)} AS value FROM h" for c, title in ev.METRIC_NAMES.items()))
def _(t):
    d = rounded(ev.headline_metrics(v.scored(t), PAIRS, _THRESHOLDS), *_HEADLINE)
    return ev.metric_frame(d, "K-Fold")


@query("concatenated_metrics", f"""{_CELLS_SQL.format("if(fold = 0, 'test', 'train') AS part, ")}
SELECT concat_ws(' ', part, model) AS metric, {r('brier', 3)} AS value FROM cells""")
def _(t):
    def part(rows):
        return ev.brier_score(v.scored(t).filter(rows), PAIRS).select(F.col("model").alias("metric"), F.col("brier").alias("value"))

    return ev.concat_metrics({"train": part("fold <> 0"), "test": part("fold = 0")})


_FBETA = f"""WITH {v.SCORED}, long AS (SELECT fold, 'signal' AS model, y, signal AS p FROM scored
  UNION ALL SELECT fold, 'noise', y, noise FROM scored), grid AS (SELECT g / 1000e0 AS th FROM generate_series(0, 999) s(g)),
counts AS (SELECT model, fold, th, count(*) FILTER (y = 1 AND p > th) AS tp, count(*) FILTER (y = 0 AND p > th) AS fp,
  count(*) FILTER (y = 1) AS np FROM long CROSS JOIN grid GROUP BY ALL), f AS (
  SELECT model, fold, th, b, ((1 + b * b) * tp)::DOUBLE / (b * b * np + tp + fp) AS f FROM counts
  CROSS JOIN (VALUES (1e0), (2e0)) x(b)), best AS (
  SELECT model, fold, b AS beta, th AS threshold, f AS fbeta FROM f
  QUALIFY row_number() OVER (PARTITION BY model, fold, b ORDER BY f DESC, th) = 1)"""


@query("fbeta_thresholds", f"{_FBETA} SELECT fold, model, beta, threshold, {r('fbeta')} AS fbeta FROM best")
def _(t):
    return rounded(ev.fbeta_thresholds(v.scored(t), PAIRS, keys=["fold"]), "fbeta")


@query("tuned_thresholds", f"{_FBETA} SELECT model, beta, {r('avg(threshold)')} AS threshold FROM best GROUP BY ALL")
def _(t):
    return rounded(ev.tuned_thresholds(v.scored(t), PAIRS, "fold"), "threshold")
