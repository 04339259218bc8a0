"""Every registered query on the smallest tables, next to its SQL check."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()
# exercised more closely in test_models.py
HEAVY = {"linear_support_vectors", "radial_support_vectors", "polynomial_support_vectors", "batch_predictions",
         "tuned_model_summary", "resampled_regression"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in HEAVY])
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in CHECKS:
        note, _ = compare(name, df, duck, CHECKS[name])
        assert not note
    else:
        assert df.count() > 0


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and "Total" in {r.row_value for r in rows}
