"""Queries on preparation, fitting, tuning, calibration and scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortline.operators import evaluate as ev, models as mo, prep as pr
from cohortline.plans import modeling, views as v
from cohortline.plans.catalog import query, r, rounded
from cohortline.session import fresh_path

FEATURES = v.DIMS


def _minmax(c: str) -> str:
    span = f"(max({c}) OVER () - min({c}) OVER ())"
    return f"coalesce(({c} - min({c}) OVER ()) / nullif({span}, 0), " \
           f"CASE WHEN {span} = 0 THEN 0 ELSE (avg({c}) OVER () - min({c}) OVER ()) / {span} END)"


@query("scaled_and_imputed", f"""WITH {v.VISITS}, x AS (SELECT visit_id, cost, height_m, 3 AS constant FROM visits)
SELECT visit_id, {r(_minmax('cost'))} AS cost, {r(_minmax('height_m'))} AS height_m, {r(_minmax('constant'))} AS constant FROM x""")
def _(t):
    d = v.visits(t).select("visit_id", "cost", "height_m", F.lit(3).alias("constant"))
    state = pr.fit_numeric_state(d, ["cost", "height_m", "constant"])
    return rounded(pr.apply_numeric_state(d, state), "cost", "height_m", "constant")


@query("standardized", f"""WITH {v.VISITS} SELECT visit_id, {r('(cost - avg(cost) OVER ()) / stddev_pop(cost) OVER ()')} AS cost,
  {r('(age - avg(age) OVER ()) / stddev_pop(age) OVER ()')} AS age FROM visits""")
def _(t):
    d = v.visits(t).select("visit_id", "cost", "age")
    return rounded(pr.apply_numeric_state(d, pr.fit_numeric_state(d, ["cost", "age"]), "standard"), "cost", "age")


@query("label_codes", f"""WITH {v.VISITS} SELECT visit_id, cost_type,
  (dense_rank() OVER (ORDER BY cost_type) - 1)::INT AS code FROM visits""")
def _(t):
    d = v.visits(t).select("visit_id", "cost_type")
    return pr.apply_label_codes(d, "cost_type", pr.fit_label_codes(d, "cost_type"), "code")


@query("categorical_vectors", f"""WITH {v.VISITS} SELECT visit_id,
  CASE WHEN visit_id % 10 = 0 THEN 0 ELSE (coalesce(comorbid, 'missing') = 'DM2')::INT END::DOUBLE AS dm2,
  CASE WHEN visit_id % 10 = 0 THEN 0 ELSE (comorbid IS NULL)::INT END::DOUBLE AS missing,
  CASE WHEN visit_id % 10 = 0 THEN 0e0 ELSE 1e0 END AS filled FROM visits""")
def _(t):
    train = pr.fill_categorical(v.visits(t).select("visit_id", "comorbid"), ["comorbid"])
    model = Pipeline(stages=pr.categorical_stages(["comorbid"])).fit(train)
    # a tenth of the rows carries a value the fit has not seen
    batch = train.withColumn("comorbid", F.when(F.col("visit_id") % 10 == 0, "new").otherwise(F.col("comorbid")))
    a = vector_to_array(F.col("comorbid__vec"))
    # alphabetical slots: 0, DM2, HTN, htn, dm, missing
    return model.transform(batch).select(
        "visit_id", a[1].alias("dm2"), a[4].alias("missing"),
        F.aggregate(a, F.lit(0.0), lambda x, y: x + y).alias("filled"))


@query("prepared_by_family", f"""WITH {v.VISITS}, f AS (SELECT visit_id, cost, height_m FROM visits)
SELECT 'lr' AS family, visit_id, {r(_minmax('height_m'))} AS height_m FROM f
UNION ALL SELECT 'xgb', visit_id, {r('height_m')} FROM f
UNION ALL SELECT 'xgb smote', visit_id, {r('coalesce(height_m, avg(height_m) OVER ())')} FROM f""")
def _(t):
    d = v.visits(t).select("visit_id", "height_m")
    out = None
    for name, plan in (("lr", pr.prep_plan("lr")), ("xgb", pr.prep_plan("xgb")),
                       ("xgb smote", pr.prep_plan("xgb", smote=True))):
        stages = pr.prep_stages(plan, ["height_m"], [])
        ready = Pipeline(stages=stages).fit(d).transform(d).select(F.lit(name).alias("family"), "visit_id", "height_m")
        out = ready if out is None else out.unionByName(ready)
    return rounded(out, "height_m")


def _probabilities(t, spec):
    model = mo.fit(v.ml(t), "vec_id", "y", FEATURES, spec)
    return rounded(model.score(v.ml(t)).select("vec_id", "y", "p"), "p")


@query("logistic_regression")
def _(t):
    return _probabilities(t, mo.Spec("lr", {"C": 1.0}))


@query("random_forest")
def _(t):
    return _probabilities(t, mo.Spec("rf", {"n_estimators": 10, "max_depth": 10, "min_samples_split": 2}))


@query("linear_support_vectors")
def _(t):
    return _probabilities(t, mo.Spec("svm", {"kernel": "linear", "C": 1.0}))


@query("radial_support_vectors")
def _(t):
    return _probabilities(t, mo.Spec("svm", {"kernel": "rbf", "C": 1.0, "gamma": "scale"}))


@query("polynomial_support_vectors")
def _(t):
    return _probabilities(t, mo.Spec("svm", {"kernel": "poly", "C": 1.0, "gamma": "auto"}))


@query("resampled_regression")
def _(t):
    out = None
    for sampler in ("over", "smote"):
        d = _probabilities(t, mo.Spec("lr", {"C": 1.0}, sampler)).select(F.lit(sampler).alias("sampler"), "*")
        out = d if out is None else out.unionByName(d)
    return out


@query("grid_search")
def _(t):
    # regressions and linear machines, all candidates and folds in the same passes
    specs = mo.grid_specs("lr") + mo.grid_specs("svm", {"kernel": ["linear"], "C": mo.GRIDS["svm"]["C"]})
    report, _ = mo.grid_search(v.ml(t), "vec_id", "y", FEATURES, specs)
    return rounded(report, "mean_score", "two_sd", digits=4)


@query("out_of_fold_scores")
def _(t):
    specs = {"lr": mo.Spec("lr", {"C": 1.0}), "rf": mo.Spec("rf", {"n_estimators": 10, "max_depth": 5})}
    return rounded(mo.out_of_fold(v.ml(t), "vec_id", "y", FEATURES, specs), "lr", "rf")


@query("calibrated_probabilities")
def _(t):
    d = v.ml(t)
    model = mo.calibrate(d, "vec_id", "y", mo.fit(d, "vec_id", "y", FEATURES, mo.Spec("lr", {"C": 1.0})), folds=10)
    return rounded(model.score(d).select("vec_id", "y", "p"), "p")


@query("tuned_model_summary")
def _(t):
    model, _, oof = mo.tune(v.ml(t), "vec_id", "y", FEATURES, mo.grid_specs("lr"))
    return rounded(ev.headline_metrics(oof, {"lr": ("y", "p")}, model.threshold), "precision", "average_precision",
                   "sensitivity", "specificity", "roc_auc", "brier", digits=4)


@query("batch_predictions")
def _(t):
    path = fresh_path(t.spark, "registry")
    d = v.ml(t)
    # all three families over ten folds; a forest and two linear machines instead of their whole grids
    grids = {"rf": {"n_estimators": [10], "max_depth": [10]}, "svm": {"kernel": ["linear"], "C": [0.01, 1.0]}}
    modeling.train_and_register(d, "vec_id", "y", FEATURES, path, samplers=["orig"], grids=grids)
    model = modeling.load_best(t.spark, path, "y")
    return rounded(modeling.predict_rows(d, "vec_id", model), "predicted_probas")


@query("decision_surface")
def _(t):
    d = mo.decision_surface(v.ml(t), "vec_id", "y", ("d0", "d1"), points=50)
    return rounded(d, "x", "y", "decision", digits=4)
