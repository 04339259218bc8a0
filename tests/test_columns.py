import pytest
from pyspark.sql import functions as F

from cohortline.operators import cohort, columns as co
from cohortline.operators.compare import compare_dataframes


def test_rename_ignores_unknown(spark):
    d = spark.createDataFrame([(1, 2)], "`Age (y)` int, x int")
    assert co.rename_columns(d, co.CLINICAL_NAMES).columns == ["Age_years", "x"]


def test_pattern_columns(spark):
    d = spark.createDataFrame([], "Daysto_b int, A_HCC int, HCC_9 int, CCS1 int, x_CCS int, BMI_a int, Daysto_a int")
    assert co.extract_relevant_days_hcc_ccs_columns(d) == ["CCS1", "Daysto_a", "Daysto_b", "HCC_9"]
    assert co.columns_matching(d, prefix="BMI_") == ["BMI_a"]


def test_cardinality_is_exact(spark):
    d = spark.createDataFrame([(1, 0, None, 5.0, "a"), (1, 1, 7, 6.0, "b"), (1, 0, 7, 7.0, "c"), (1, 1, 9, 7.5, "d")],
                              "one int, two int, twoandgap int, four double, s string")
    assert co.columns_with_more_values(d, 2) == ["four"]
    assert co.columns_with_more_values(d, 1) == ["two", "twoandgap", "four"]
    assert co.columns_with_more_values(d, 3) == ["four"]
    assert co.columns_with_more_values(d, 4) == []


def test_drop_and_conform(spark):
    d = spark.createDataFrame([(1, 2, 3)], "k int, a int, b int")
    with pytest.raises(KeyError):
        co.drop_columns(d, ["z"])
    assert co.drop_columns(d, ["a", "a", "z"], strict=False).columns == ["k", "b"]
    with pytest.raises(KeyError):
        co.conform(d, ["b", "z"])
    assert co.conform(d, ["b", "z"], "k", 0).first().asDict() == {"k": 1, "b": 3, "z": 0}


def test_ids_are_unique_and_stable(spark):
    d = spark.range(20000).withColumnRenamed("id", "name")
    a = co.add_ids(d, "name").collect()
    b = co.add_ids(d.repartition(13), "name").collect()
    assert {(r.patient_id, r.name) for r in a} == {(r.patient_id, r.name) for r in b}
    ids = [r.patient_id for r in a]
    assert len(set(ids)) == 20000 and min(ids) >= 100_000_000 and max(ids) <= 999_999_999
    assert {r.patient_id for r in co.add_ids(d.limit(9), "name", num_digits=1).collect()} == set(range(1, 10))
    with pytest.raises(Exception, match="more rows than 1-digit ids"):
        co.add_ids(d.limit(10), "name", num_digits=1).collect()


def test_replace_keeps_and_map_drops_unmapped(spark):
    d = spark.createDataFrame([("Marocco",), ("Italy",), (None,)], "v string").coalesce(1)
    out = d.select(co.replace_values(F.col("v"), {"Marocco": "Morocco"}), co.map_values(F.col("v"), {"Italy": "I"}))
    assert [tuple(r) for r in out.collect()] == [("Morocco", None), ("Italy", "I"), (None, None)]


def test_one_hot_replay(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    state = co.fit_one_hot(train, ["c"])
    out = co.apply_one_hot(spark.createDataFrame([("a",), ("new",), (None,)], "c string").coalesce(1), state).collect()
    assert [(r.c_a, r.c_b) for r in out] == [(1, 0), (0, 0), (0, 0)]


def test_excluding_keeps_missing(spark):
    d = spark.createDataFrame([("0",), ("x",), (None,)], "v string")
    assert {r.v for r in cohort.exclude_values(d, "v", ["0"]).collect()} == {"x", None}


@pytest.mark.parametrize("other, kind", [
    ([(1, 1, 4), (2, 2, 5), (3, 3, 6)], "none"), ([(1, 1, 4), (2, 2, 5), (3, 3, 6), (4, 4, 7)], "shape"),
    ([(1, 1, 4), (2, 2, 5), (3, 3, 9)], "content")])
def test_compare(spark, other, kind):
    a = spark.createDataFrame([(1, 1, 4), (2, 2, 5), (3, 3, 6)], "k int, A int, B int")
    found, cells = compare_dataframes(a, spark.createDataFrame(other, a.schema), "k")
    assert found == kind
    if kind == "content":
        assert [tuple(r) for r in cells.collect()] == [(3, "B", "6", "9")]


def test_compare_names_types_and_missing(spark):
    a = spark.createDataFrame([(1, 1, None)], "k int, A int, B int")
    assert compare_dataframes(a, a.withColumnRenamed("B", "C"), "k")[0] == "columns"
    assert compare_dataframes(a, a.withColumn("B", F.col("B").cast("double")), "k")[0] == "types"
    assert compare_dataframes(a, a, "k")[0] == "none"
