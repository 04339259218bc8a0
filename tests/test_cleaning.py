import pytest
from pyspark.sql import functions as F

from cohortline.functions import cleaning as cl


def test_dirty_strings(spark):
    d = spark.createDataFrame([("2,300", "", "..", 60), ("-200", "400", "-9..", 20), ("-2,450", "--", "-400", -90)],
                              "col1 string, col2 string, col3 string, col4 int")
    out = cl.clean_dataframe(d, ["col1"])
    rows = out.collect()
    assert [r.col1 for r in rows] == [2300.0, -200.0, -2450.0]
    assert [r.col2 for r in rows] == [None, 400.0, None]
    assert [r.col3 for r in rows] == [None, None, -400.0]
    assert [r.col4 for r in rows] == [60, 20, -90]


def test_null_tokens_search_anywhere_but_match_empty_exactly(spark):
    d = spark.createDataFrame([("a--b",), ("-9..",), ("",), (" ",), ("-",), (".",), (None,)], "v string")
    assert [r[0] for r in d.select(cl.null_tokens(F.col("v"))).collect()] == [None, None, None, " ", "-", ".", None]


@pytest.mark.parametrize("values, expected, dtype", [
    (["1", "2", "three", "4.5", "NaN"], ["1", "2", "three", "4.5", "NaN"], "string"),
    (["apple", "banana", "cherry"], ["apple", "banana", "cherry"], "string"),
    (["1", "2", None, "4.5"], [1.0, 2.0, None, 4.5], "double"),
    (["1", " 2 ", "3"], [1, 2, 3], "bigint"),
    (["1", None, "3"], [1.0, None, 3.0], "double"),
    (["1", "", "NaN"], [1.0, None, None], "double"),
    (["1", "12d"], ["1", "12d"], "string"),
    (["1", "0x1p3"], ["1", "0x1p3"], "string"),
    (["1", "-inf", "Infinity"], [1.0, float("-inf"), float("inf")], "double"),
    (["1e3", ".5", "-2."], [1000.0, 0.5, -2.0], "double"),
    ([], [], "string"),
    ([None, None], [None, None], "string"),
])
def test_whole_column_inference(spark, values, expected, dtype):
    d = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    out = cl.safe_to_numeric(d)
    assert out.schema["v"].dataType.simpleString() == dtype
    assert [r.v for r in out.collect()] == expected


def test_numbers_and_booleans_pass_through(spark):
    d = spark.createDataFrame([(1.0, True), (4.5, False)], "v double, b boolean")
    out = cl.safe_to_numeric(d)
    assert out.schema == d.schema and out.collect() == d.collect()


def test_state_fitted_once_applies_to_another_table(spark):
    state = cl.fit_numeric(spark.createDataFrame([("1", "x")], "a string, b string"))
    out = cl.apply_numeric(spark.createDataFrame([("bad", "y"), ("7", "z")], "a string, b string"), state)
    assert [tuple(r) for r in out.collect()] == [(None, "y"), (7, "z")]
    assert cl.apply_numeric(out.select("a", "b"), cl.fit_numeric(out)).schema == out.schema


def test_fill(spark):
    d = spark.createDataFrame([(None, None), (1.0, "x")], "a double, b string")
    assert cl.handle_missing_values(d, ["a"]) is d
    assert [r.a for r in cl.handle_missing_values(d, ["a"], 0).collect()] == [0.0, 1.0]
    with pytest.raises(TypeError):
        cl.handle_missing_values(d, ["b"], 0)
    with pytest.raises(KeyError):
        cl.handle_missing_values(d, ["c"], 0)


def test_nan_becomes_null(spark):
    d = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "a double, b int")
    assert [tuple(r) for r in cl.nan_to_null(d).collect()] == [(None, 1), (2.0, 2)]
