"""Preparation, fits, tuning and attributions against closed forms and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from cohortline.operators import evaluate as ev, explain as ex, kernels as ke, linear, models as mo, prep as pr, registry
from cohortline.operators import scores
from cohortline.operators.scores import ForestScore, LandmarkScore, LinearScore, PolynomialScore, Scaling
from cohortline.plans import modeling
from cohortline.session import fresh_path

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 3))
    y = (x @ [1.5, -1.0, 0.3] - 0.8 + rng.normal(scale=0.7, size=240) > 0).astype(int)
    pdf = pd.DataFrame(x, columns=COLS).assign(id=np.arange(240), y=y)
    return pdf, spark.createDataFrame(pdf).repartition(3).persist()


def test_scaling_with_constant_and_missing(spark):
    d = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, None), (None, None, None)], "x double, k double, e double")
    out = pr.apply_numeric_state(d, pr.fit_numeric_state(d, ["x", "k", "e"])).collect()
    assert [tuple(r) for r in out] == [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.5, 0.0, 0.0)]


def test_prep_stage_saves_and_loads(spark, data):
    _, d = data
    model = Pipeline(stages=[pr.NumericPrep(columns=COLS)]).fit(d)
    path = fresh_path(spark, "prep")
    model.write().save(path)
    again = type(model).load(path)
    assert again.transform(d).orderBy("id").collect() == model.transform(d).orderBy("id").collect()


@pytest.mark.parametrize("family", ["lr", "rf", "xgb", "cat"])
@pytest.mark.parametrize("selection, smote", [(False, False), (True, False), (False, True), (True, True)])
def test_prep_plan(family, selection, smote):
    plan = pr.prep_plan(family, selection, smote)
    if family in ("lr", "rf"):
        assert plan == {"numeric": ["minmax", "impute"], "categorical": ["fill", "one_hot"]}
    elif selection or smote:
        assert plan == {"numeric": ["impute"], "categorical": ["fill", "one_hot"]}
    else:
        assert plan == {"numeric": [], "categorical": ["one_hot"]}


def test_unseen_category_is_all_zeros(spark):
    d = spark.createDataFrame([("a",), ("b",), ("a",)], "g string")
    model = Pipeline(stages=pr.prep_stages(pr.prep_plan("lr"), [], ["g"])).fit(d)
    out = model.transform(spark.createDataFrame([("a",), ("b",), ("z",)], "g string").coalesce(1)).collect()
    assert [list(r["g__vec"].toArray()) for r in out] == [[1, 0], [0, 1], [0, 0]]


def newton(x, y, w, c):
    """Weighted ridge logistic regression, intercept free."""
    z = np.column_stack([x, np.ones(len(x))])
    beta, penalty = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        gradient = c * z.T @ (w * (p - y)) + penalty @ beta
        hessian = c * (z * (w * p * (1 - p))[:, None]).T @ z + penalty
        beta = beta - np.linalg.solve(hessian, gradient)
    return 1 / (1 + np.exp(-z @ beta))


@pytest.mark.parametrize("c", [1e-4, 1.0])
def test_regression_matches_newton(data, c):
    pdf, d = data
    x = pdf[COLS].to_numpy()
    x = (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0))
    w = np.where(pdf.y == 1, len(pdf) / (2 * pdf.y.sum()), len(pdf) / (2 * (1 - pdf.y).sum()))
    model = mo.fit(d, "id", "y", COLS, mo.Spec("lr", {"C": c}))
    got = model.score(d).orderBy("id").toPandas().p
    np.testing.assert_allclose(got, newton(x, pdf.y.to_numpy(), w, c), atol=1e-6)


def test_linear_margin_reaches_the_hinge_optimum(data):
    pdf, d = data
    training = mo.prepare(d, "id", "y", COLS)
    svc = mo.fit_prepared(training, mo.Spec("svm", {"kernel": "linear", "C": 1.0})).stages.stages[-1]
    x = pdf[COLS].to_numpy()
    x = (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0))
    sign = 2 * pdf.y.to_numpy() - 1
    w = np.where(sign > 0, 240 / (2 * pdf.y.sum()), 240 / (2 * (240 - pdf.y.sum())))

    def objective(b, b0):
        return (w * np.maximum(0, 1 - sign * (x @ b + b0))).sum() / w.sum() + (b @ b) / (2 * 240)

    b, b0, best = np.zeros(3), 0.0, np.inf
    for i in range(1, 40001):  # subgradient steps
        on = w * (sign * (x @ b + b0) < 1) / w.sum()
        step = 20.0 / np.sqrt(i)
        b = b - step * (b / 240 - (on * sign) @ x)
        b0 += step * (on * sign).sum()
        if i % 50 == 0:
            best = min(best, objective(b, b0))
    assert objective(svc.coefficients, svc.intercept) <= best * 1.003


def test_platt_matches_newton(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * m - 0.5)))).astype(float)
    a, b = mo.fit_platt(spark.createDataFrame(pd.DataFrame({"m": m, "y": y})), "m", "y")
    z, beta = np.column_stack([m, np.ones(400)]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (p - y))
    np.testing.assert_allclose((a, b), beta, atol=1e-3)


def test_landmarks_span_the_kernel(spark):
    x = np.random.default_rng(3).normal(size=(300, 3))
    d = spark.createDataFrame(pd.DataFrame(x, columns=COLS)).repartition(4)
    for most in (300, 40):
        landmarks, error = ke.choose_landmarks(d, COLS, Scaling.none(3), 0.3, most)
        assert len(landmarks) <= most and (error <= ke.TOLERANCE) == (most == 300)
        left = ke.residuals(x, landmarks, 0.3)
        assert left.max() <= error + 1e-9
        near, own = ke.rbf(x, landmarks, 0.3), ke.rbf(landmarks, landmarks, 0.3)
        off = np.abs(ke.rbf(x, x, 0.3) - near @ np.linalg.solve(own, near.T)).max()
        assert off <= error + 1e-9


def exact_machine(kernel, sign, weight, c):
    """Dual coordinate ascent in pairs, for a free intercept: the margins of the rows themselves."""
    n, limit = len(sign), c * weight
    alpha, margin = np.zeros(n), np.zeros(n)
    for _ in range(200_000):
        gradient = sign - margin
        up, down = (sign > 0) & (alpha < limit) | (sign < 0) & (alpha > 0), (sign > 0) & (alpha > 0) | (sign < 0) & (alpha < limit)
        i = np.flatnonzero(up)[gradient[up].argmax()]
        j = np.flatnonzero(down)[gradient[down].argmin()]
        if gradient[i] - gradient[j] < 1e-9:
            break
        bend = max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12)
        room = (limit[i] - alpha[i] if sign[i] > 0 else alpha[i], alpha[j] if sign[j] > 0 else limit[j] - alpha[j])
        step = min((gradient[i] - gradient[j]) / bend, *room)
        alpha[i] += sign[i] * step
        alpha[j] -= sign[j] * step
        margin += step * (kernel[:, i] - kernel[:, j])
    return margin + (gradient[i] + gradient[j]) / 2


@pytest.mark.parametrize("params", [{"kernel": "linear", "C": 1.0}, {"kernel": "rbf", "C": 10.0, "gamma": 0.5},
                                    {"kernel": "rbf", "C": 1.0, "gamma": "scale"}, {"kernel": "poly", "C": 10.0, "gamma": "auto", "coef0": 1.0}])
def test_margins_match_an_exact_solver(data, params):
    pdf, d = data
    x = pdf[COLS].to_numpy()
    x = (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0))
    sign = 2.0 * pdf.y.to_numpy() - 1.0
    w = np.where(sign > 0, 240 / (2 * pdf.y.sum()), 240 / (2 * (240 - pdf.y.sum())))
    gamma = {"auto": 1 / 3, "scale": 1 / (3 * x.var())}.get(params.get("gamma"), params.get("gamma"))
    kernel = {"linear": lambda: x @ x.T, "rbf": lambda: ke.rbf(x, x, gamma),
              "poly": lambda: (gamma * x @ x.T + 1.0) ** 3}[params["kernel"]]()
    want = exact_machine(kernel, sign, w, params["C"])
    model = mo.fit_prepared(mo.prepare(d, "id", "y", COLS), mo.Spec("svm", params | {"tolerance": 1e-6}))
    got = model.with_margin(d).orderBy("id").toPandas().margin
    np.testing.assert_allclose(got, want, atol=0.05)


@pytest.mark.parametrize("spec", [mo.Spec("rf", {"n_estimators": 10, "max_depth": None, "min_samples_split": 2}),
                                  mo.Spec("svm", {"kernel": "linear", "C": 1.0}),
                                  mo.Spec("svm", {"kernel": "rbf", "C": 10.0, "gamma": "scale"}),
                                  mo.Spec("svm", {"kernel": "poly", "C": 1.0, "degree": 2})])
def test_families_rank_well_and_keep_columns(data, spec):
    _, d = data
    out = mo.fit(d, "id", "y", COLS, spec).score(d)
    assert out.columns == [*d.columns, "p"]
    assert ev.ranking_metrics(out, {"m": ("y", "p")}).first().roc_auc > 0.85
    lo, hi = out.agg(F.min("p"), F.max("p")).first()
    assert 0 <= lo < hi <= 1


def test_unknown_family_kernel_label_and_sampler(data):
    _, d = data
    for spec in (mo.Spec("knn"), mo.Spec("svm", {"kernel": "sigmoid"}), mo.Spec("lr", {}, "under")):
        with pytest.raises(ValueError):
            mo.fit(d, "id", "y", COLS, spec)
    with pytest.raises(Exception, match="must be 0 or 1"):
        mo.fit(d.withColumn("y", F.col("y") + 1), "id", "y", COLS, mo.Spec("lr"))


def test_fold_statistics_equal_direct_ones(data):
    _, d = data
    holed = d.withColumn("a", F.when(F.col("id") % 9 != 0, F.col("a"))).withColumn("fold", F.col("id") % 4)
    stats = mo.label_statistics(holed, "y", COLS, ["fold"])
    state, sizes = mo.combined([r for r in stats if r["fold"] != 2], COLS)
    rest = holed.filter("fold <> 2")
    for got, want in zip(state, pr.fit_numeric_state(rest, COLS).collect()):
        np.testing.assert_allclose([got[k] for k in ("low", "high", "mean")], [want[k] for k in ("low", "high", "mean")])
    assert sizes == {float(r.y): r["count"] for r in rest.groupBy("y").count().collect()}


def test_out_of_fold_uses_other_folds_only(data):
    pdf, d = data
    out = mo.out_of_fold(d, "id", "y", COLS, {"lr": mo.Spec("lr", {"C": 1.0})}, folds=3).toPandas()
    assert sorted(out.id) == list(range(240)) and set(out.fold) == {0, 1, 2}
    held_out = out[out.fold == 1].id.tolist()
    rest = d.filter(~F.col("id").isin(held_out))
    want = mo.fit(rest, "id", "y", COLS, mo.Spec("lr", {"C": 1.0})).score(d).toPandas().set_index("id").p
    got = out[out.fold == 1].set_index("id").lr
    np.testing.assert_allclose(got, want[got.index], atol=1e-8)


@pytest.mark.parametrize("sampler", [None, "over", "smote"])
def test_folds_fitted_together_equal_single_fits(data, sampler):
    _, d = data
    d = d.withColumn("a", F.when(F.col("id") % 9 != 0, F.col("a")))
    specs = {"weak": mo.Spec("lr", {"C": 1e-3}, sampler), "strong": mo.Spec("lr", {"C": 5.0}, sampler)}
    if sampler is None:
        specs |= {"machine": mo.Spec("svm", {"kernel": "linear", "C": 0.5}),
                  "kernel": mo.Spec("svm", {"kernel": "poly", "degree": 2, "C": 0.5, "coef0": 1.0, "gamma": "scale"})}
    out = mo.out_of_fold(d, "id", "y", COLS, specs, folds=3, calibrated=False).toPandas().set_index("id")
    held_out = out.index[out.fold == 2].tolist()
    rest = d.filter(~F.col("id").isin(held_out))
    for name, spec in specs.items():
        model = mo.fit_prepared(mo.prepare(rest, "id", "y", COLS, sampler), spec)
        want = model.with_margin(d.filter(F.col("id").isin(held_out)), "m").toPandas().set_index("id").m
        np.testing.assert_allclose(out[name].loc[held_out], want.loc[held_out], atol=1e-5)


def test_passes_do_not_grow_with_candidates_and_folds(data, monkeypatch):
    _, d = data
    passes = []
    whole = linear._pass
    monkeypatch.setattr(linear, "_pass", lambda *a: passes.append(1) or whole(*a))
    counts = []
    for folds, n in ((3, 1), (10, 6)):
        specs = {f"s{i}": mo.Spec("svm", {"kernel": "linear", "C": c}) for i, c in enumerate(np.logspace(-4, 2, 10)[-n:])}
        specs |= {f"l{i}": mo.Spec("lr", {"C": c}) for i, c in enumerate((1e-4, 1.0)[-n:])}
        passes.clear()
        assert mo.out_of_fold(d, "id", "y", COLS, specs, folds=folds, calibrated=False).count() == 240
        counts.append(len(passes))
    assert counts[1] <= 2 * counts[0] and counts[1] < 100


def test_models_too_many_for_one_pass_are_split(data, monkeypatch):
    _, d = data
    specs = {f"l{i}": mo.Spec("lr", {"C": 10.0 ** i}) for i in range(3)}
    want = mo.out_of_fold(d, "id", "y", COLS, specs, folds=3).toPandas().set_index("id").sort_index()
    monkeypatch.setattr(linear, "CELLS_PER_PASS", 60)
    got = mo.out_of_fold(d, "id", "y", COLS, specs, folds=3).toPandas().set_index("id").sort_index()
    np.testing.assert_allclose(got[list(specs)], want[list(specs)], atol=1e-9)


def test_a_training_set_of_one_class_is_an_error(data):
    _, d = data
    with pytest.raises(ValueError, match="both classes"):
        mo.fit(d.filter("y = 1"), "id", "y", COLS, mo.Spec("lr"))


def test_calibrated_margins_of_folds(data):
    _, d = data
    specs = {"machine": mo.Spec("svm", {"kernel": "linear", "C": 1.0}), "forest": mo.Spec("rf", {"n_estimators": 3, "max_depth": 3})}
    out = mo.out_of_fold(d, "id", "y", COLS, specs, folds=2)
    assert out.columns == ["id", "y", "fold", "machine", "forest"]
    got = out.agg(*[f(c) for c in specs for f in (F.min, F.max)]).first()
    assert all(0 <= v <= 1 for v in got)
    k = out.filter("fold = 1").toPandas().set_index("id").sort_index()
    rest = d.filter(~F.col("id").isin(k.index.tolist()))
    one = mo.fit(rest, "id", "y", COLS, specs["machine"]).score(d, "p").toPandas().set_index("id").p
    np.testing.assert_allclose(k.machine, one[k.index], atol=1e-4)


def test_train_register_pick_predict_explain(spark, data):
    _, d = data
    path = fresh_path(spark, "registry")
    grids = {"lr": {"C": [1e-4, 1.0]}, "rf": {"n_estimators": [10], "max_depth": [3], "min_samples_split": [2]}}
    logged = modeling.train_and_register(d, "id", "y", COLS, path, ["lr", "rf"], ["orig", "over"], grids, folds=3)
    assert logged.count() == 4 * 6
    run = registry.read_table(spark, path, "runs").filter("run_name = 'rf_orig_training'").first()["run_id"]
    assert mo.Classifier.load(f"{path}/models/{run}").platt is not None
    assert modeling.evaluate_registered(d, "id", "y", path, run, folds=3).count() == 6
    model = modeling.load_best(spark, path, "y", "K-Fold AUC ROC")
    out = modeling.predict_rows(d, "id", model)
    assert out.columns == ["id", "predictions", "predicted_probas"]
    assert out.filter((F.col("predicted_probas") > model.threshold).cast("int") != F.col("predictions")).count() == 0
    assert out.count() == 240
    table = modeling.explain_rows(d, "id", model, 2, 20, "y")
    assert table.columns == ["id", "Top 2 Features", "y_pred_proba", "y_pred", "TP", "FN", "FP", "TN"]
    assert table.agg(F.sum(F.col("TP") + F.col("FN") + F.col("FP") + F.col("TN"))).first()[0] == 240
    with pytest.raises(ValueError):
        modeling.load_best(spark, path, "other")


def test_saved_margin_model_scores_the_same(spark, data):
    _, d = data
    model = mo.fit(d, "id", "y", COLS, mo.Spec("svm", {"kernel": "rbf", "gamma": "auto"}))
    model.threshold = 0.3
    again = mo.Classifier.load(model.save(fresh_path(spark, "model")))
    assert again.threshold == 0.3 and again.platt == model.platt
    a, b = (m.score(d).orderBy("id").toPandas().p for m in (model, again))
    np.testing.assert_allclose(a, b, rtol=1e-12)


def test_surface_spans_the_data(data):
    pdf, d = data
    out = mo.decision_surface(d, "id", "y", ("a", "b"), points=20).toPandas()
    assert len(out) == 400 and (out.side == (out.decision > 0)).all()
    z = (pdf.a - pdf.a.mean()) / pdf.a.std(ddof=0)
    np.testing.assert_allclose((out.x.min(), out.x.max()), (z.min() - 1, z.max() + 1))


def test_surface_with_text_feature(data):
    _, d = data
    texted = d.withColumn("g", F.when(F.col("a") > 0, "high").otherwise("low"))
    spec = mo.Spec("svm", {"kernel": "linear"})
    out = mo.decision_surface(texted, "id", "y", ("g", "b"), spec, points=10)
    assert out.count() == 100


@pytest.mark.parametrize("p", [3, 13])
def test_attributions_sum_to_the_gap_from_the_background(spark, p):
    rng = np.random.default_rng(p)
    cols = [f"f{i}" for i in range(p)]
    x = rng.normal(size=(12, p))
    d = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=np.arange(12)))
    weights = rng.normal(size=p)

    def score(f):
        z = F.lit(0.2)
        for c, w in zip(cols, weights):
            z += F.lit(float(w)) * F.col(c)
        return f.withColumn("p", 1 / (1 + F.exp(-z)))

    long = ex.kernel_shap(d, "id", cols, d.filter("id < 5"), score, permutations=8).toPandas()
    f = 1 / (1 + np.exp(-(0.2 + x @ weights)))
    np.testing.assert_allclose(long.groupby("id").phi.sum().sort_index(), f - f[:5].mean(), atol=1e-9)
    exact = ex.shapley(d, "id", cols, d.filter("id < 5"), ex.LinearScore(weights, 0.2)).toPandas()
    np.testing.assert_allclose(exact.groupby("id").phi.sum().sort_index(), f - f[:5].mean(), atol=1e-9)


def test_exact_attributions_of_an_interacting_score():
    """Against the definition: the mean over all orders of what a feature adds."""
    from itertools import permutations

    rng = np.random.default_rng(1)
    rows, other = rng.normal(size=(3, 4)), rng.normal(size=(5, 4))

    def score(x):
        return x[:, 0] * x[:, 1] + np.tanh(x[:, 2] * x[:, 3]) - x[:, 0]

    masks, weights = ex.coalition_plan(4)
    got = ex.coalition_values(score, rows, other, masks) @ weights.T
    for x, phi in zip(rows, got):
        want, orders = np.zeros(4), list(permutations(range(4)))
        for order in orders:
            mask = np.zeros(4, bool)
            for j in order:
                before = score(np.where(mask, x, other)).mean()
                mask[j] = True
                want[j] += (score(np.where(mask, x, other)).mean() - before) / len(orders)
        np.testing.assert_allclose(phi, want, atol=1e-12)


def test_too_many_features_need_permutations(spark):
    with pytest.raises(ValueError):
        ex.coalition_plan(21)
    masks, weights = ex.coalition_plan(70, permutations=3)
    assert masks.shape[1] == 70 and abs(weights.sum(axis=0)).sum() < 70


def test_array_and_frame_attributions_agree(data):
    _, d = data
    model = mo.fit(d, "id", "y", COLS, mo.Spec("lr", {"C": 1.0}))
    some = d.withColumn("a", F.when(F.col("id") % 7 != 0, F.col("a")))
    back = d.filter("id < 10")
    one = ex.shapley(some, "id", COLS, back, model.linear_score()).toPandas()
    two = ex.kernel_shap(some, "id", COLS, back, lambda f: model.score(f, "p")).toPandas()
    both = one.merge(two, on=["id", "feature"])
    assert len(both) == 720
    np.testing.assert_allclose(both.phi_x, both.phi_y, atol=1e-9)


@pytest.mark.parametrize("gamma, coef0, degree", [(0.5, 0.0, 2), (0.1, 1.0, 3), (2.0, 0.0, 3)])
def test_polynomial_map_has_the_kernel_as_inner_product(gamma, coef0, degree):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(6, 4)), rng.normal(size=(5, 4))
    got = ke.monomials(x, gamma, coef0, degree) @ ke.monomials(y, gamma, coef0, degree).T
    assert ke.PolynomialMap(gamma, coef0, degree).size(4) == len(ke.monomials(x, gamma, coef0, degree)[0])
    np.testing.assert_allclose(got, (gamma * x @ y.T + coef0) ** degree, rtol=1e-10, atol=1e-10)


def test_grid_has_no_repeated_candidates():
    specs = mo.grid_specs("svm")
    assert len({s.label() for s in specs}) == len(specs) == 10 + 2 * 80


def test_forest_is_the_same_however_rows_come(data):
    _, d = data
    spec = mo.Spec("rf", {"n_estimators": 5, "max_depth": 4})
    a, b = (mo.fit(x, "id", "y", COLS, spec).score(d).orderBy("id").toPandas().p
            for x in (d.repartition(1), d.repartition(7, "a")))
    np.testing.assert_array_equal(a, b)


def test_forest_is_the_same_whatever_the_session(spark, data):
    _, d = data
    spec, found = mo.Spec("rf", {"n_estimators": 5, "max_depth": 4}), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("8", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(mo.fit(d, "id", "y", COLS, spec).score(d).orderBy("id").toPandas().p)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    np.testing.assert_array_equal(*found)


def enumerated(score, rows, background):
    """Shapley values by all coalitions of mixed rows."""
    masks, weights = ex.coalition_plan(rows.shape[1])
    return ex.coalition_values(score, rows, background, masks) @ weights.T


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 13))
    x[rng.random(x.shape) < 0.05] = np.nan
    z = np.nan_to_num(x)
    y = (z[:, 0] * z[:, 1] + z[:, 2] - z[:, 12] + rng.normal(scale=0.3, size=300) > 0).astype(int)
    cols = [f"f{i}" for i in range(13)]
    pdf = pd.DataFrame(x, columns=cols).assign(id=np.arange(300), y=y)
    return x, cols, spark.createDataFrame(pdf).select(
        "id", "y", *[F.nullif(c, F.lit(float("nan"))).alias(c) for c in cols]).repartition(3).persist()


def test_forest_attributions_equal_enumeration(wide):
    x, cols, d = wide
    model = mo.fit(d, "id", "y", cols, mo.Spec("rf", {"n_estimators": 10, "max_depth": 10}))
    score = model.array_score()
    assert isinstance(score, ForestScore) and score.additive
    p = model.score(d).orderBy("id").toPandas().p
    np.testing.assert_allclose(score(x), p, atol=1e-12)
    rows, background = x[:20], x[100:112]
    np.testing.assert_allclose(score.attributions(rows, background), enumerated(score, rows, background), atol=1e-9)
    long = ex.shapley(d.filter("id < 20"), "id", cols, d.filter("id between 100 and 111"), score).toPandas()
    got = long.pivot(index="id", columns="feature", values="phi")[cols].to_numpy()
    np.testing.assert_allclose(got, score.attributions(rows, background), atol=1e-12)


def test_calibrated_forest_attributions_equal_enumeration(wide):
    x, cols, d = wide
    model = mo.fit(d, "id", "y", cols, mo.Spec("rf", {"n_estimators": 4, "max_depth": 5}))
    model.platt = (3.0, -1.2)
    score = model.array_score()
    np.testing.assert_allclose(score(x), model.score(d).orderBy("id").toPandas().p, atol=1e-12)
    rows, background = x[:5], x[100:107]
    np.testing.assert_allclose(score.attributions(rows, background), enumerated(score, rows, background), atol=1e-9)
    np.testing.assert_allclose(score.attributions(rows, background).sum(1), score(rows) - score(background).mean(), atol=1e-9)


@pytest.mark.parametrize("platt", [(3.0, -1.2), (-900.0, 40.0)])
def test_pairs_of_rows_have_coalitions_of_what_tells_them_apart_only(wide, monkeypatch, platt):
    x, cols, d = wide
    score = mo.fit(d, "id", "y", cols, mo.Spec("rf", {"n_estimators": 4, "max_depth": 5})).array_score()
    score.platt = platt
    rows, background = np.vstack([x[:4], x[100:101]]), np.vstack([x[100:106], x[100:101]])
    worked = []
    joined = scores.below
    monkeypatch.setattr(scores, "below", lambda table, k, join: (worked.append(table.size), joined(table, k, join)))
    got = score.attributions(rows, background)
    assert 0 < sum(worked) < 0.5 * len(rows) * len(background) * 2 ** len(cols)
    np.testing.assert_allclose(got, enumerated(score, rows, background), atol=1e-9)
    for cells in (1, 40):  # slices of pairs, slices of rows
        monkeypatch.setattr(scores, "PAIR_CELLS", cells)
        monkeypatch.setattr(scores, "CELLS_AT_ONCE", cells)
        np.testing.assert_allclose(score.attributions(rows, background), got, atol=1e-12)


def test_a_forest_of_bare_leaves_attributes_nothing():
    score = ForestScore.of_nodes([[{"id": 0, "left": -1, "right": -1, "feature": -1, "threshold": 0.0, "value": 0.4}]], Scaling.none(3))
    assert score(np.zeros((2, 3))).tolist() == [0.4, 0.4] and not score.attributions(np.ones((2, 3)), np.zeros((4, 3))).any()
    score.platt = (2.0, 0.1)
    assert not score.attributions(np.ones((2, 3)), np.zeros((4, 3))).any()


@pytest.mark.parametrize("params", [{"kernel": "rbf", "gamma": 0.4, "landmarks": 30}, {"kernel": "poly", "degree": 2}, {"kernel": "linear"}])
def test_kernel_attributions_equal_enumeration(data, params):
    pdf, d = data
    model = mo.fit(d, "id", "y", COLS, mo.Spec("svm", {"C": 1.0} | params))
    score, x = model.array_score(), pdf[COLS].to_numpy()
    assert isinstance(score, {"rbf": LandmarkScore, "poly": PolynomialScore, "linear": LinearScore}[params["kernel"]])
    np.testing.assert_allclose(score(x), model.score(d).orderBy("id").toPandas().p, atol=1e-9)
    got = ex.attributions(score, x[:6], x[50:70])
    np.testing.assert_allclose(got, enumerated(score, x[:6], x[50:70]), atol=1e-9)
    table = modeling.explain_rows(d.filter("id < 40"), "id", model, 2, 20, "y")
    assert table.count() == 40


def test_linear_parts_beyond_the_range_of_exponentials():
    rows, background = np.array([[500.0, -480.0], [1.0, 2.0]]), np.array([[-700.0, 690.0], [0.0, 0.0]])
    score = ex.LinearScore([1.0, 1.0], 0.3)
    np.testing.assert_allclose(ex.attributions(score, rows, background), enumerated(score, rows, background), atol=1e-12)


def test_rows_are_not_copied_too_often(spark):
    d = spark.range(3).select("id", *[F.lit(1.0).alias(f"f{i}") for i in range(14)])
    with pytest.raises(ValueError, match="copied"):
        ex.kernel_shap(d, "id", [f"f{i}" for i in range(14)], [[0.0] * 14] * 100, lambda f: f)
    with pytest.raises(ValueError, match="coalitions"):
        ex.shapley(spark.range(1).select("id", *[F.lit(1.0).alias(f"f{i}") for i in range(21)]), "id", [f"f{i}" for i in range(21)],
                   [[0.0] * 21], ex.LinearScore([1.0] * 21, 0.0))


def test_attribution_does_not_depend_on_the_batch(spark, data):
    _, d = data
    model, _, _ = mo.tune(d, "id", "y", COLS, [mo.Spec("lr", {"C": 1.0})], folds=3)
    assert model.platt and len(model.background) == 100
    again = mo.Classifier.load(model.save(fresh_path(spark, "model")))
    whole = modeling.explain_rows(d, "id", again, 3).filter("id = 7").collect()
    assert modeling.explain_rows(d.filter("id in (7, 8)"), "id", again, 3).filter("id = 7").collect() == whole


def test_additive_score_has_known_attributions(spark):
    d = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 5.0), (2, -1.0, 0.5)], "id int, u double, v double")
    long = ex.kernel_shap(d, "id", ["u", "v"], d, lambda f: f.withColumn("p", 2 * F.col("u") - F.col("v"))).toPandas()
    wide = long.pivot(index="id", columns="feature", values="phi")
    np.testing.assert_allclose(wide.u, 2 * (np.array([1, 3, -1]) - 1.0))
    np.testing.assert_allclose(wide.v, -(np.array([2, 5, 0.5]) - 2.5))


def test_top_features_break_ties_by_position(spark):
    d = spark.createDataFrame([(0.5, -0.5, 0.1, -0.501), (None, 0.0, -2.0, 1.0)],
                              "f1 double, f2 double, f3 double, f4 double").coalesce(1)
    cols = ["f1", "f2", "f3", "f4"]
    assert [r[0] for r in d.select(ex.top_names(cols, 2)).collect()] == ["f1, f2", "f3, f4"]
    assert d.select(ex.top_json(cols, 2)).first()[0] == '{"f1":0.5,"f2":0.5}'
    assert d.select(ex.top_map(cols, 4)).collect()[1][0] == {"f3": 2.0, "f4": 1.0, "f2": 0.0}


def test_empty_background_is_an_error(spark):
    d = spark.createDataFrame([(0, 1.0)], "id int, u double")
    with pytest.raises(ValueError):
        ex.kernel_shap(d, "id", ["u"], d.filter("id > 9"), lambda f: f)


def test_writers_at_the_same_time_start_one_run(spark):
    from concurrent.futures import ThreadPoolExecutor

    path = fresh_path(spark, "registry")
    with ThreadPoolExecutor(6) as pool:
        ids = list(pool.map(lambda _: registry.start_or_resume(spark, path, "y_model", "lr_orig_training"), range(6)))
    other = registry.start_or_resume(spark, path, "y_model", "rf_orig_training")
    runs = registry.read_table(spark, path, "runs")
    assert len(set(ids)) == 1 and sorted(r.run_id for r in runs.collect()) == sorted({ids[0], other})
    assert registry.start_or_resume(spark, path, "y_model", "lr_orig_training") == ids[0]
    assert registry.latest_runs(runs).filter("n_runs = 1").count() == 2
