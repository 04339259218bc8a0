"""Exact neighbors and rebalancing against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortline.operators import neighbors as nb, resample as rs

COLS = ["a", "b", "c"]


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame(x, columns=COLS).assign(id=np.arange(len(x)))).repartition(6)


def brute(x, k):
    out = {}
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:k]
        out[i] = order
    return out


def points(kind):
    rng = np.random.default_rng(2)
    if kind == "cloud":
        return rng.normal(size=(700, 3))
    if kind == "clusters":
        return np.round(rng.normal(size=(600, 3)) * 0.01 + rng.integers(0, 3, (600, 1)) * 50, 4)
    if kind == "copies":  # a third of all rows are one point
        x = rng.normal(size=(600, 3))
        x[::3] = [0.25, 0.25, 0.25]
        return x
    if kind == "grid":  # many equal distances
        return rng.integers(0, 5, (400, 3)).astype(float)
    return np.column_stack([np.zeros(300), np.zeros(300), np.arange(300.0)])  # flat


@pytest.mark.parametrize("kind", ["cloud", "clusters", "copies", "grid", "flat"])
@pytest.mark.parametrize("leaf_rows", [40, 100000])
def test_neighbors_match_brute_force(spark, kind, leaf_rows):
    x = points(kind)
    got = nb.nearest_neighbors(frame(spark, x), "id", COLS, 5, leaf_rows).toPandas()
    want = brute(x, 5)
    assert len(got) == 5 * len(x)
    for i, part in got.sort_values(["id", "rank"]).groupby("id"):
        d = ((x - x[i]) ** 2).sum(axis=1)
        np.testing.assert_allclose(part.d2, d[want[i]], atol=1e-12)
        if kind != "clusters":
            assert list(part.neighbor_id) == want[i]


def test_leaves_are_split_until_they_are_bounded(spark, monkeypatch):
    """With samples that allow two leaves a tree, deep levels are needed; one corner holds most points."""
    monkeypatch.setattr(nb, "SAMPLE_ROWS", 2 * nb.SAMPLE_PER_LEAF)
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(300, 3)), rng.normal(size=(900, 3)) * 1e-3 + 5])
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "vid long, vec array<double>")
    tree, boxes = nb.fit_tree(vectors, len(x), 30)
    assert boxes["n"].max() <= 60 and boxes["n"].sum() == len(x) and len(boxes) >= 20
    leaf = nb._leaf_of(x, tree)
    for r in boxes.itertuples():
        mine = x[leaf == r.leaf]
        assert len(mine) == r.n
        np.testing.assert_array_equal([mine.min(0), mine.max(0)], [[r.lo0, r.lo1, r.lo2], [r.hi0, r.hi1, r.hi2]])
    got = nb.nearest_neighbors(frame(spark, x), "id", COLS, 4, 30).toPandas()
    want = brute(x, 4)
    assert all(list(p.sort_values("rank").neighbor_id) == want[i] for i, p in got.groupby("id")) and len(got) == 4 * len(x)


def test_rounds_visit_few_leaves(spark):
    """In clusters, all but the first leaves of a point lie beyond its k-th distance."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 6)) * 0.05 + rng.normal(size=(40, 6))[rng.integers(0, 40, 4000)] * 3
    vectors = spark.createDataFrame([(i, p.tolist(), [i]) for i, p in enumerate(x)], "vid long, vec array<double>, ids array<long>")
    visits = []
    near = {r.vid: [n.id for n in r.near] for r in nb.vector_neighbors(vectors, 5, 100, visits).collect()}
    leaves = 40
    assert 1 + sum(asks for _, asks in visits) / len(x) < 0.2 * leaves
    for i in range(0, 4000, 97):
        d = ((x - x[i]) ** 2).sum(axis=1)
        assert near[i] == np.lexsort((np.arange(4000), d))[:6].tolist()


def test_points_without_structure_meet_cells_not_leaves(spark):
    """In a cloud of 13 dimensions nearly all of the small leaves are within reach: what is sent follows the groups."""
    x = np.random.default_rng(5).normal(size=(1500, 13))
    vectors = spark.createDataFrame([(i, p.tolist(), [i]) for i, p in enumerate(x)], "vid long, vec array<double>, ids array<long>")
    visits = []
    near = {r.vid: [(n.d2, n.id) for n in r.near] for r in nb.vector_neighbors(vectors, 5, 8, visits).collect()}
    assert len(near) == 1500 and sum(asks for _, asks in visits) / 1500 < 2 * spark.sparkContext.defaultParallelism
    for i in range(0, 1500, 41):
        d = ((x - x[i]) ** 2).sum(axis=1)
        order = np.lexsort((np.arange(1500), d))[:6]
        assert [n for _, n in near[i]] == order.tolist()
        np.testing.assert_allclose([d2 for d2, _ in near[i]], d[order], atol=1e-12)


@pytest.mark.parametrize("away, spread", [(1e6, 1e-3), (1e25, 1e22), (0.0, 1e-30), (3.0, 0.0)])
def test_products_in_single_precision_miss_nothing(away, spread, monkeypatch):
    rng = np.random.default_rng(6)
    x = away + spread * np.round(rng.normal(size=(300, 4)), 2)
    x[-1] += 1e3 * spread
    pdf = pd.DataFrame({"vec": list(x), "ids": [[i] for i in range(300)]})
    monkeypatch.setattr(nb, "PENDING", 50)
    got = nb.Points(pdf, 30).nearest(x, np.full(300, np.inf), 6).lists(300)
    for i in range(300):
        gap = sum((x[:, j] - x[i, j]) ** 2 for j in range(4))
        assert [n for _, n in got[i]] == np.lexsort((np.arange(300), gap))[:6].tolist()


def test_missing_components_are_near_to_nothing(spark):
    rows = [(i, float(i % 7), None if i % 5 == 0 else float(i), 0.0) for i in range(60)]
    got = nb.nearest_neighbors(spark.createDataFrame(rows, "id long, a double, b double, c double"), "id", COLS, 3, 10).toPandas()
    there = [r for r in rows if r[2] is not None]
    assert set(got.id) == {r[0] for r in there} and set(got.neighbor_id) <= set(got.id)
    want = brute(np.array([r[1:] for r in there]), 3)
    for i, r in enumerate(there):
        assert list(got[got.id == r[0]].sort_values("rank").neighbor_id) == [there[j][0] for j in want[i]]


def test_cells_inside_a_leaf(monkeypatch):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(500, 4)), 1)
    pdf = pd.DataFrame({"vec": list(x), "ids": [[2 * i, 2 * i + 1] if i % 3 == 0 else [2 * i] for i in range(500)]})
    owner = np.repeat(np.arange(500), pdf["ids"].map(len))
    ids = np.concatenate(pdf["ids"].to_numpy())
    monkeypatch.setattr(nb, "CELLS_AT_ONCE", 700)
    for cell_rows in (7, 1000):
        got = nb.Points(pdf, cell_rows).nearest(x[:50], np.full(50, np.inf), 6).lists(50)
        for i in range(50):
            d = ((x - x[i]) ** 2).sum(axis=1)[owner]
            order = np.lexsort((ids, d))[:6]
            assert [n for _, n in got[i]] == ids[order].tolist()


def test_no_points(spark):
    d = spark.createDataFrame([], "id long, a double, b double, c double")
    assert nb.nearest_neighbors(d, "id", COLS, 5).count() == 0


def test_many_queries_on_one_leaf_are_split(spark, monkeypatch):
    monkeypatch.setattr(nb, "QUERIES_PER_TASK", 20)
    x = points("cloud")
    got = nb.nearest_neighbors(frame(spark, x), "id", COLS, 3, 50).toPandas()
    want = brute(x, 3)
    assert all(list(p.sort_values("rank").neighbor_id) == want[i] for i, p in got.groupby("id"))


def labeled(spark, n=300, minority=40):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    y = np.array([1] * minority + [0] * (n - minority))
    return x, y, frame(spark, x).withColumn("y", F.when(F.col("id") < minority, 1).otherwise(0))


def test_synthetic_rows_lie_between_neighbors(spark):
    x, y, d = labeled(spark)
    out = rs.smote(d, "id", "y", COLS).toPandas()
    assert (out.y == 1).sum() == (out.y == 0).sum() == 260
    near = brute(x[y == 1], 5)
    for r in out[out.draw > 0].itertuples():
        base, p = x[r.id], np.array([r.a, r.b, r.c])
        fits = []
        for j in near[r.id]:
            step = x[j] - base
            u = (p - base) @ step / (step @ step)
            fits.append(0 <= u < 1 and np.allclose(base + u * step, p))
        assert any(fits)


def test_synthetic_minority_of_two_and_one(spark):
    d = spark.createDataFrame([(i, int(i < 2), float(i), 0.0, 0.0) for i in range(9)], "id int, y int, a double, b double, c double")
    assert rs.smote(d, "id", "y", COLS).groupBy("y").count().agg(F.min("count"), F.max("count")).first()[:] == (7, 7)
    with pytest.raises(ValueError):
        rs.smote(d.filter("id > 0"), "id", "y", COLS)


def test_oversampling_reaches_parity_and_copies_rows(spark):
    x, y, d = labeled(spark)
    out = rs.random_oversample(d, "id", "y").toPandas()
    assert (out.y == 1).sum() == (out.y == 0).sum() == 260
    assert (out[out.draw == 0].id.sort_values().to_numpy() == np.arange(300)).all()
    copies = out[out.draw > 0]
    np.testing.assert_array_equal(copies[COLS].to_numpy(), x[copies.id])
    assert copies.id.nunique() > 30


def test_balanced_classes_get_no_draws(spark):
    d = spark.createDataFrame([(1, 0), (2, 1)], "id int, y int")
    assert rs.random_oversample(d, "id", "y").count() == 2


def test_folds_are_even_per_class_and_repeatable(spark):
    _, _, d = labeled(spark)
    a = rs.stratified_folds(d, "id", "y", 7).toPandas()
    sizes = a.groupby(["y", "fold"]).size().unstack()
    assert sizes.shape == (2, 7) and (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()
    b = rs.stratified_folds(d.repartition(3), "id", "y", 7).toPandas()
    assert a.set_index("id").fold.sort_index().equals(b.set_index("id").fold.sort_index())


def test_holdout_and_unknown_split(spark):
    _, _, d = labeled(spark)
    shares = {"train": 0.5, "valid": 0.25, "test": 0.25}
    counts = rs.holdout_split(d, "id", "y", shares).groupBy("y", "split").count().collect()
    assert {(r.y, r.split): r["count"] for r in counts} == {
        (1, "train"): 20, (1, "valid"): 10, (1, "test"): 10, (0, "train"): 130, (0, "valid"): 65, (0, "test"): 65}
    assert rs.choose_split(d, "id", "y", "test", shares).count() == 75
    with pytest.raises(ValueError):
        rs.choose_split(d, "id", "y", "other", shares)
    with pytest.raises(ValueError):
        rs.holdout_split(d, "id", "y", {"train": 0.5})


def test_mock_ranges(spark):
    d = rs.mock_data(spark.range(100), "id")
    r = d.agg(*[F.min(c).alias(c) for c, *_ in rs.MOCK_COLUMNS], *[F.max(c).alias("m" + c) for c, *_ in rs.MOCK_COLUMNS]).first()
    assert d.count() == 100
    assert all(lo <= r[c] and (r["m" + c] < hi) for c, _, lo, hi in rs.MOCK_COLUMNS)
