"""Sources, sinks, cross tables, baseline tables, registry, clinical replay and streams."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortline.functions import stats
from cohortline.operators import correlate, crosstab as ct, describe as de, evaluate as ev, registry as rg, tableone as t1
from cohortline.plans import clinical as cl, views as v
from cohortline.session import fresh_path
from cohortline.sources import files
from cohortline.streaming.scoring import score_files

SF = "/root/testdata/sf0.001"


def test_csv_key_must_be_unique(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    path = files.write_csv(d, fresh_path(spark, "csv"))
    with pytest.raises(ValueError):
        files.scan_csv(spark, path, d.schema, "k")
    assert files.scan_csv(spark, path, d.schema).count() == 2


def test_csv_renders_nested_columns_as_json(spark):
    d = spark.createDataFrame([(1, {"a": 0.5}, [1, 2])], "k int, m map<string,double>, l array<int>")
    path = files.write_csv(d, fresh_path(spark, "csv"))
    back = spark.read.option("header", True).option("escape", "\\").csv(path).first()
    assert (back.m, back.l) == ('{"a":0.5}', "[1,2]")


def test_lists_round_trip_in_order_without_repeats(spark):
    lists = {"drop": ["z", "a", "z"], "empty": [], "keep": ["b"]}
    path = files.save_lists(spark, lists, fresh_path(spark, "lists"))
    assert files.load_lists(spark, path) == {"drop": ["z", "a"], "keep": ["b"]}


def test_top_values(spark):
    d = spark.createDataFrame([(x,) for x in ["apple"] * 3 + ["banana"] * 3 + ["cherry"] * 4 + ["date", "fig"]], "v string")
    assert {r.value for r in de.top_n(d, "v", 3).collect()} == {"apple", "banana", "cherry"}
    assert de.top_n(d, "v", 50).count() == 5
    assert de.top_n(d.filter("v = 'none'"), "v").count() == 0


def test_margins_add_up(spark):
    d = v.visits(v.Tables(spark, SF))
    rows = {r.row_value: r for r in ct.crosstab_margins(d, "technique", "pain", [0, 1]).collect()}
    assert rows["Total"]["Total"] == d.count() == rows["Laser"]["Total"] + rows["Traditional"]["Total"]
    assert all(r["0"] + r["1"] == r["Total"] for r in rows.values())


def test_absent_column_in_fixed_order(spark):
    d = spark.createDataFrame([("r", "a"), ("s", "b")], "r string, c string")
    rows = {r.row_value: r for r in ct.crosstab_reindexed(d, "r", "c", ["a", "b", "never"]).collect()}
    assert (rows["r"]["a"], rows["r"]["b"], rows["r"]["never"]) == (1, 0, None)


def test_wide_and_narrow_correlations_agree(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(200, 5)), columns=list("abcde"))
    pdf.loc[::7, "b"] = np.nan
    pdf["e"] = 3.0
    d = spark.createDataFrame(pdf).select(*[F.nullif(c, F.lit(float("nan"))).alias(c) for c in pdf]).repartition(4)
    want = pdf.corr()
    for out in [correlate.correlations(d).collect()]:
        assert len(out) == 15
        for r in out:
            if "e" in (r.x, r.y):
                assert r.r is None
            else:
                assert abs(r.r - want.loc[r.x, r.y]) < 1e-12
    assert correlate.correlations(d, full=True).count() == 25


@pytest.mark.parametrize("width", [24, 25])
def test_correlations_of_any_width_follow_one_rule(spark, width):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(50, width)), columns=[f"c{i}" for i in range(width)])
    pdf.loc[::5, "c0"] = np.nan
    d = spark.createDataFrame(pdf).withColumn("c1", F.lit(None).cast("double"))
    rows = {(r.x, r.y): r.r for r in correlate.correlations(d).collect()}
    assert rows["c0", "c1"] is None and rows["c1", "c1"] is None
    assert abs(rows["c0", "c2"] - pdf.c0.corr(pdf.c2)) < 1e-12


def test_tail_probabilities():
    # closed forms: one degree of freedom for t, two for chi-square, half-integers through erfc
    from math import atan, erfc, exp, pi, sqrt
    for t in (0.0, 0.3, 1.0, 5.0, 40.0):
        got = stats.incomplete_beta(0.5, 0.5, 1 / (1 + t * t))
        assert abs(got - (1 - 2 * atan(t) / pi)) < 1e-12
        wide = stats.incomplete_beta(1.0, 0.5, 2 / (2 + t * t))
        assert abs(wide - (1 - t / sqrt(2 + t * t))) < 1e-12
    for x in (0.01, 1.0, 7.0, 60.0):
        assert abs(stats.upper_gamma(1.0, x / 2) - exp(-x / 2)) < 1e-13
        assert abs(stats.upper_gamma(0.5, x / 2) - erfc(sqrt(x / 2))) < 1e-13


def test_baseline_display(spark):
    d = v.visits(v.Tables(spark, SF))
    n0, n1 = (d.filter(f"pain = {g}").count() for g in (0, 1))
    out = t1.generate_table1(d, "continuous", ["age", "height_m"], "pain")
    assert out.columns == ["Variable", "Type", "Mean", "SD", "Median", "Min", "Max", "Mode", "Missing (n)", "Missing (%)",
                           "Count", "Proportion (%)", f"0 (n = {n0})", f"1 (n = {n1})", "P-value"]
    assert out.count() == 2
    out = t1.generate_table1(d, "categorical", ["technique"], "pain")
    assert {r.Variable for r in out.collect()} == {"technique = Laser", "technique = Traditional"}
    assert t1.generate_table1(d, "categorical", ["technique"]).count() == 2
    with pytest.raises(ValueError):
        t1.generate_table1(d, "other", ["age"])


def test_metric_frames(spark):
    d = spark.createDataFrame([("accuracy", .8753), ("precision", .9231), ("recall", .7892)], "metric string, value double")
    out = [tuple(r) for r in ev.concat_metrics({"train": d, "test": d.filter("metric = 'recall'")}).collect()]
    assert sorted(out) == [("test recall", .789), ("train accuracy", .875), ("train precision", .923), ("train recall", .789)]
    assert ev.concat_metrics({"train": d.limit(0)}).count() == 0


def test_registry(spark):
    path = fresh_path(spark, "registry")
    assert rg.latest_run(rg.read_table(spark, path, "runs"), "e", "lr_orig") is None
    with pytest.raises(ValueError):
        rg.latest_run(rg.read_table(spark, path, "runs"), "e", "lr_orig", required=True)
    run = rg.start_or_resume(spark, path, "e", "lr_orig")
    assert rg.start_or_resume(spark, path, "e", "lr_orig") == run
    other = rg.start_or_resume(spark, path, "e", "rf_orig")
    assert rg.log_metrics(spark, path, run, {}) == rg.log_metrics(spark, path, run, None) == 0
    assert rg.log_metrics(spark, path, run, {"accuracy": .9, "loss": 1}) == 2
    rg.log_metrics(spark, path, other, {"accuracy": .8, "loss": .5})
    rg.log_params(spark, path, run, {"C": 1.0, "depth": None})
    runs, metrics = (rg.read_table(spark, path, n) for n in ("runs", "run_metrics"))
    assert rg.find_best_model(runs, metrics, "e", "accuracy") == ("lr_orig", "lr")
    assert rg.find_best_model(runs, metrics, "e", "loss", "min") == ("rf_orig", "rf")
    assert rg.read_table(spark, path, "run_params").count() == 2
    # a run that is logged again counts with its latest value
    rg.log_metrics(spark, path, run, {"accuracy": .2}, step=1)
    again = rg.read_table(spark, path, "run_metrics")
    assert rg.find_best_model(runs, again, "e", "accuracy") == ("rf_orig", "rf")
    assert again.filter("logged_at is null").count() == 0
    for bad in (("none", "accuracy", "max"), ("e", "accuracy", "best")):
        with pytest.raises(ValueError):
            rg.find_best_model(runs, metrics, *bad)


def test_latest_run_by_start_time(spark):
    rows = [("e", str(i), "lr", datetime(2025, 1, 1 + i % 3)) for i in range(6)]
    assert rg.latest_run(spark.createDataFrame(rows, rg.RUNS_SCHEMA), "e", "lr") == "5"


def test_clinical_replay_on_new_rows(spark):
    raw = v.clinical(v.Tables(spark, SF))
    state = cl.fit_clinical(raw)
    assert "Functional_Outcomes_Edema" not in state.lists["low_variance"]
    assert "Intraop_Mean_Pulse_Ox_Percent" in state.lists["low_variance"]
    again = cl.ClinicalState.load(spark, state.save(fresh_path(spark, "clinical")))
    batch = raw.filter(F.col("`Anesthesia Type`") == "lidocaine").limit(20)
    x = cl.apply_clinical(batch, again, target=None)
    assert x.columns == ["patient_id", *state.lists["X_columns"]]
    y = cl.apply_clinical(raw, again)
    assert y.columns[-1] == cl.TARGET and y.filter("Age_years < 18").count() == 0
    assert cl.feature_names(again) == state.lists["X_columns"]
    # the age filter reaches the scan side of all derivations, and only needed columns are read
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan


def test_stream_scores_new_files_once(spark):
    source, sink, offsets = (fresh_path(spark, n) for n in ("in", "out", "offsets"))
    d = v.scored(v.Tables(spark, SF)).select("id", "signal")
    run = lambda: score_files(spark, source, d.schema, lambda x: x.withColumn("hit", F.col("signal") > 0.5), sink,
                              offsets).awaitTermination()
    d.filter("id % 2 = 0").write.parquet(source)
    run()
    d.filter("id % 2 = 1").write.mode("append").parquet(source)
    run()
    out = spark.read.parquet(sink)
    assert out.count() == d.count() == out.select("id").distinct().count()


def test_threshold_of_scores_that_are_all_zero(spark):
    d = spark.createDataFrame([(1, 0.0, 0.9), (0, 0.0, 0.1), (1, 0.0, 0.8)], "y int, zero double, some double")
    rows = {(r.model, r.beta): r for r in ev.fbeta_thresholds(d, {"zero": ("y", "zero"), "some": ("y", "some")}).collect()}
    assert len(rows) == 4 and (rows["zero", 1.0].threshold, rows["zero", 1.0].fbeta) == (0.0, 0.0)
    assert rows["some", 1.0].fbeta == 1.0
