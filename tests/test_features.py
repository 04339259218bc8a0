import pytest
from pyspark.sql import functions as F

from cohortline.functions import features as fx


def column(spark, values, dtype, expression):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in d.orderBy("i").select(expression(F.col("v"))).collect()]


def test_category_gaps(spark):
    values = [18.49, 18.5, 24.89, 24.9, 24.95, 25.0, 29.9, 29.95, 30.0, None]
    assert column(spark, values, "double", fx.bmi_category) == [
        "Underweight", "Normal_Weight", "Normal_Weight", "Obese", "Obese", "Overweight", "Obese", "Obese", "Obese", "Obese"]
    assert column(spark, values, "double", lambda c: fx.bmi_category(c, "who")) == [
        "Underweight", "Normal_Weight", "Normal_Weight", "Normal_Weight", "Normal_Weight", "Overweight", "Overweight",
        "Overweight", "Obese", None]


def test_band_edges(spark):
    ages = [17.9, 18.0, 18.5, 30.0, 99.0, 100.0, None]
    assert column(spark, ages, "double", fx.band) == [None, None, "18-29", "18-29", "90-99", "90-99", None]
    assert column(spark, ages, "double", lambda c: fx.band(c, closed="left")) == [
        None, "18-29", "18-29", "30-39", "90-99", None, None]
    assert column(spark, ages, "double", lambda c: fx.band_order(c, closed="left")) == [None, 0, 0, 1, 7, None, None]


def test_pressure(spark):
    d = spark.createDataFrame([("120/80",), (None,), ("bad",), ("120",), ("1/2/3",)], "bp string").coalesce(1)
    out = fx.calculate_map(fx.split_bp_column(d, "bp"), combined_bp_col="bp", on_error="null").collect()
    assert [(r.SBP, r.DBP, r.MAP) for r in out] == [
        (120.0, 80.0, 93.33), (None, None, None), (None, None, None), (120.0, None, None), (1.0, 2.0, 1.67)]
    with pytest.raises(Exception, match="not a blood pressure: bad"):
        fx.calculate_map(d, combined_bp_col="bp").collect()
    with pytest.raises(ValueError):
        fx.calculate_map(d)


def test_flags(spark):
    values = ["0", "DM2", "adm", "HTN", None]
    assert column(spark, values, "string", fx.presence_flag) == [0, 1, 1, 1, 1]
    assert column(spark, values, "string", lambda c: fx.mention_flag(c, "DM")) == [0, 1, 1, 0, 0]
    assert column(spark, ["Traditional", "Laser", None], "string", lambda c: fx.binary_encode(c, "Traditional")) == [0, 1, 1]


def test_units_and_zero_height(spark):
    d = spark.createDataFrame([(180.0, 70.0), (150.0, 0.0)], "w double, h double").coalesce(1)
    out = fx.calculate_bmi(d, "w", "h", "lbs", "in").collect()
    assert out[0].BMI == round(180 * 0.45359237 / (70 * 0.0254) ** 2, 2) and out[1].BMI is None
    assert out[0].w == 180.0
    with pytest.raises(ValueError):
        fx.calculate_bmi(d, "w", "h", "stone")


@pytest.fixture
def strata(spark):
    return spark.createDataFrame([(1, 1, 0, 0, 0, 25), (2, 0, 1, 0, 0, 35), (3, 0, 0, 1, 0, 45), (4, 1, 0, 0, 0, 55)],
                                 "PatientID int, race_white int, race_black int, race_asian int, race_other int, age int")


def test_other_column_is_row_maximum(strata):
    out = fx.create_stratified_other_column(strata, ["race_white"], ["race_asian", "race_black"], "race_other", "PatientID")
    assert [r.race_other for r in out.orderBy("PatientID").collect()] == [0, 1, 1, 0]
    assert out.columns == ["PatientID", "race_white", "race_other"]


def test_other_column_without_sources_stays(strata):
    out = fx.create_stratified_other_column(strata, [], [], "race_other", "PatientID")
    assert [r.race_other for r in out.orderBy("PatientID").collect()] == [0, 0, 0, 0]


@pytest.mark.parametrize("edges, most", [([0, 30, 40, 100], 3), ([0, 30, 60], 2), ([0, 20, 40, 60], 3)])
def test_age_band_never_missing(strata, edges, most):
    holed = strata.withColumn("age", F.when(F.col("PatientID") != 1, F.col("age")))
    for d in (strata, holed):
        out = fx.create_stratified_other_column(d, ["race_white"], patient_id="PatientID", age="age", age_bin="g",
                                                bin_ages=edges)
        bands = [r.g for r in out.collect()]
        assert None not in bands and len(set(bands) - {"Unknown"}) <= most


def test_unknown_stratum(strata):
    with pytest.raises(KeyError):
        fx.create_stratified_other_column(strata, ["nothing"], patient_id="PatientID")


def test_strict_threshold_and_flags(spark):
    rows = [(0, .1), (1, .8), (1, .7), (0, .2), (1, .9), (0, .4), (1, .6), (1, .85)]
    d = spark.createDataFrame(rows, "y int, p double").coalesce(1)
    c = fx.threshold_class(F.col("p"), 0.6)
    assert [r[0] for r in d.select(c).collect()] == [0, 1, 1, 0, 1, 0, 0, 1]
    flags = d.select(*[x.alias(n) for n, x in fx.confusion_flags(F.col("y"), c).items()]).groupBy().sum().first()
    assert tuple(flags) == (4, 1, 0, 3)
