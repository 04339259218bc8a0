"""Distributed ranks, quantiles and running totals under skew, against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortline.operators import describe as de, distribution as di, evaluate as ev, ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most rows, one value with a third of them, one tiny group, missing values."""
    rng = np.random.default_rng(5)
    n = 6000
    g = np.where(rng.random(n) < 0.9, "hot", np.where(rng.random(n) < 0.99, "cold", "rare"))
    x = np.where(rng.random(n) < 0.34, 7.0, rng.lognormal(0, 3, n))
    z = rng.integers(0, 4, n).astype(float)
    z[rng.random(n) < 0.1] = np.nan
    pdf = pd.DataFrame({"g": g, "x": x, "z": z})
    return pdf, spark.createDataFrame(pdf).withColumn("z", F.nullif("z", F.lit(float("nan")))).repartition(7)


@pytest.mark.parametrize("buckets", [2, 64, 300])
def test_quantiles_match_numpy(skewed, buckets):
    pdf, d = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    for keys in ([], ["g"]):
        out = ranks.exact_quantiles(d, ["x", "z"], probs, keys, buckets).collect()
        assert len(out) == 2 * (3 if keys else 1)
        for r in out:
            want = pdf[pdf.g == r["g"]] if keys else pdf
            values = want[r["variable"]].dropna()
            assert r["n"] == len(values)
            np.testing.assert_allclose([r[f"q{i}"] for i in range(len(probs))], np.quantile(values, probs), rtol=1e-12)


def test_quantiles_skip_missing_groups_and_empty_columns(spark):
    d = spark.createDataFrame([(None, 1.0, None), ("a", 2.0, None), ("a", 4.0, None)], "g string, x double, y double")
    out = ranks.exact_quantiles(d, ["x", "y"], [0.5], ["g"]).collect()
    assert [(r.g, r.variable, r.n, r.q0) for r in out] == [("a", "x", 2, 3.0)]


@pytest.mark.parametrize("n", [1, 2, 3, 9, 10, 4000, 9001])
def test_quantiles_next_to_their_bracket(spark, n):
    """Ranks that fall one beyond what a summary returns, for every small size and a few large ones."""
    values = np.arange(n) * 1.5
    d = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)
    probs = [0.0, 0.001, 0.25, 1 / 3, 0.5, 0.75, 0.9999, 1.0]
    for accuracy in (ranks.ACCURACY, 100):
        r = ranks.exact_quantiles(d, ["x"], probs, [], accuracy).first()
        np.testing.assert_allclose([r[f"q{i}"] for i in range(len(probs))], np.quantile(values, probs), rtol=1e-12)


def test_quantiles_of_no_rows(spark):
    d = spark.createDataFrame([], "g string, x double")
    assert ranks.exact_quantiles(d, ["x"], [0.5], ["g"]).count() == 0 and ranks.exact_quantiles(d, ["x"], [0.5]).count() == 0


@pytest.mark.parametrize("kind", ["dense", "far", "few", "one", "constant"])
def test_density_matches_its_definition(spark, kind):
    rng = np.random.default_rng(4)
    x = {"dense": rng.normal(50, 20, 3000), "far": np.append(rng.normal(50, 1, 500), [1e9, -1e9, 49.0]),
         "few": np.array([10.0, 10.0, 90.0]), "one": np.array([3.0]), "constant": np.full(20, 7.0)}[kind]
    out = di.kernel_density(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", 0, 100).orderBy("point").toPandas()
    assert list(out.point) == list(range(500))
    np.testing.assert_allclose(out.x, np.linspace(0, 100, 500))
    if kind in ("one", "constant"):
        assert out.density.isna().all()
        return
    h = x.std(ddof=1) * len(x) ** -0.2
    want = np.exp(-0.5 * ((out.x.to_numpy()[:, None] - x) / h) ** 2).sum(axis=1) / (np.sqrt(2 * np.pi) * h * len(x))
    np.testing.assert_allclose(out.density, want, rtol=1e-9, atol=1e-15 / h)


def test_hashed_rank_is_dense_per_class(skewed, spark):
    _, d = skewed
    keyed = d.withColumn("id", F.monotonically_increasing_id()).persist()
    out = ranks.hashed_rank(keyed, "id", 3, ["g"]).groupBy("g").agg(
        F.min("rank"), F.max("rank"), F.countDistinct("rank"), F.count("*")).collect()
    assert all(lo == 0 and hi == n - 1 and distinct == n for _, lo, hi, distinct, n in out)
    keyed.unpersist()


def test_hashed_rank_keeps_rows_with_missing_key(spark):
    d = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, g string")
    assert sorted((r.g or "", r["rank"]) for r in ranks.hashed_rank(d, "id", 1, ["g"]).collect()) == [
        ("", 0), ("", 1), ("a", 0)]


def brute(y, p):
    """Area, step precision and trapezoid area straight from their definitions."""
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    points = [(0.0, 1.0)]
    for t in sorted(set(p), reverse=True):
        called = p >= t
        points.append((y[called].sum() / y.sum(), y[called].mean()))
    ap = sum((b[0] - a[0]) * b[1] for a, b in zip(points, points[1:]))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    return auc, ap, area


@pytest.mark.parametrize("kind", ["ties", "dense", "crowded", "third"])
def test_ranking_metrics_match_definitions(spark, kind):
    rng = np.random.default_rng(1)
    n = 1500
    y = (rng.random(n) < 0.3).astype(int)
    p = {"ties": rng.integers(0, 20, n) / 20, "dense": rng.random(n) * 0.7 + 0.3 * y,
         "crowded": rng.random(n) * 1e-9, "third": np.where(rng.random(n) < 0.34, 0.5, rng.random(n))}[kind]
    d = spark.createDataFrame(pd.DataFrame({"y": y, "p": p})).repartition(5)
    r = ev.ranking_metrics(d, {"m": ("y", "p")}).first()
    np.testing.assert_allclose((r.roc_auc, r.average_precision, r.pr_auc), brute(y, p), rtol=1e-9)
    # a monotone change of scale changes nothing
    again = ev.ranking_metrics(d.withColumn("p", F.log(F.col("p") + 1e-3) * 5 - 2), {"m": ("y", "p")}).first()
    if kind != "crowded":
        np.testing.assert_allclose(again.roc_auc, r.roc_auc, rtol=1e-9)


def test_small_scored_cases(spark):
    d = spark.createDataFrame(list(zip([0, 1, 1, 0, 1, 0, 1, 1], [.1, .8, .35, .2, .9, .4, .4, .85])), "y int, p double")
    r = ev.ranking_metrics(d, {"m": ("y", "p")}).first()
    assert round(r.average_precision, 6) == 0.926667 and round(r.roc_auc, 6) == 0.9
    d = spark.createDataFrame([(0, .1), (1, .8), (1, .7), (0, .2), (1, .9), (0, .4), (1, .6), (1, .85)], "y int, p double")
    h = ev.headline_metrics(d, {"m": ("y", "p")}, 0.6).first()
    assert (h.tp, h.fn, h.fp, h.tn) == (4, 1, 0, 3)
    assert h.roc_auc == 1.0 and h.average_precision == 1.0 and round(h.brier, 7) == 0.0665625


def test_one_class_only_gives_no_area(spark):
    d = spark.createDataFrame([(1, .1), (1, .8)], "y int, p double")
    r = ev.ranking_metrics(d, {"m": ("y", "p")}).first()
    assert r.roc_auc is None and r.average_precision == 1.0


def test_boxes_and_density(skewed):
    pdf, d = skewed
    out = {r.group_value: r for r in di.box_stats(d, "g", ["x"]).collect()}
    for g, part in pdf.groupby("g"):
        q1, q2, q3 = np.quantile(part.x, [0.25, 0.5, 0.75])
        inside = part.x[(part.x >= q1 - 1.5 * (q3 - q1)) & (part.x <= q3 + 1.5 * (q3 - q1))]
        r = out[g]
        np.testing.assert_allclose((r.q1, r.median, r.q3, r.whisker_low, r.whisker_high),
                                   (q1, q2, q3, inside.min(), inside.max()))
        assert r.outliers == len(part) - len(inside)
    x = pdf.z.dropna().to_numpy()
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(0, 4, 50)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (np.sqrt(2 * np.pi) * h * len(x))
    got = di.kernel_density(d, "z", 0, 4, 50).orderBy("point").toPandas()
    np.testing.assert_allclose(got.density, want, rtol=1e-9)


def test_describe_approximate_switch(skewed):
    _, d = skewed
    exact, rough = (de.describe(d, ["x"], a).first() for a in (None, 10000))
    assert exact["count"] == rough["count"] == 6000 and abs(exact.q50 - rough.q50) <= 0.01 * exact.q50


def test_one_bucket_holds_only_its_share(spark):
    """Rows per bucket stay near even for a skewed column, so no task gets the bulk."""
    d = spark.range(20000).select(F.exp(F.rand(3) * 40).alias("x"))
    splits = ranks.order_splits(d, ["x"], 50)
    top = ranks.with_buckets(d, splits).groupBy("x__bucket").count().agg(F.max("count")).first()[0]
    assert top < 3 * 20000 / 50
