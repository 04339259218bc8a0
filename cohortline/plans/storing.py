"""Queries on sources, sinks, fitted lists, table collections, columns and the run registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.functions import cleaning, features as fx
from cohortline.operators import columns as co, registry
from cohortline.operators.compare import cell_differences
from cohortline.operators.crosstab import stacked_crosstabs
from cohortline.operators.describe import low_variance_columns
from cohortline.plans import clinical as cl, views as v
from cohortline.plans.catalog import query, r, rounded
from cohortline.session import fresh_path, materialize
from cohortline.sources import files
from cohortline.streaming.scoring import score_files


@query("scan_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000")
def _(t):
    return files.scan_parquet(t.spark, f"{t.folder}/orders.parquet", ["o_orderkey", "o_totalprice"]).filter(
        "o_totalprice >= 100000")


@query("scan_csv_by_key", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(t):
    wanted = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = files.write_csv(wanted, fresh_path(t.spark, "customer-csv"))
    return files.scan_csv(t.spark, path, wanted.schema, key="c_custkey")


@query("two_outputs_from_one_pass", f"""WITH {v.VISITS}
SELECT 'described' AS output, visit_id, cost, NULL::BIGINT AS age FROM visits WHERE age >= 18
UNION ALL SELECT 'modeled', visit_id, NULL, age FROM visits WHERE age >= 18""")
def _(t):
    a, b = fresh_path(t.spark, "described"), fresh_path(t.spark, "modeled")
    files.write_outputs(v.visits(t).filter("age >= 18"), {
        a: lambda d: d.select("visit_id", "cost"), b: lambda d: d.select("visit_id", "age")})
    left = t.spark.read.parquet(a).select(F.lit("described").alias("output"), "visit_id", "cost",
                                          F.lit(None).cast("bigint").alias("age"))
    right = t.spark.read.parquet(b).select(F.lit("modeled").alias("output"), "visit_id",
                                           F.lit(None).cast("double").alias("cost"), "age")
    return left.unionByName(right)


@query("csv_output_with_maps", f"""WITH {v.SCORED}
SELECT id, concat('{{"signal":', signal::VARCHAR, ',"noise":', noise::VARCHAR, '}}') AS scores FROM scored""")
def _(t):
    d = v.scored(t).select("id", F.create_map(F.lit("signal"), F.col("signal"), F.lit("noise"), F.col("noise"))
                           .alias("scores"))
    path = files.write_csv(d, fresh_path(t.spark, "scores-csv"))
    return t.spark.read.schema("id bigint, scores string").option("header", True).option("escape", "\\").csv(path)


_LISTED = ("visit_id", "age", "technique", "comorbid", "weight_kg", "infection_rare")


@query("fitted_lists", f"WITH {v.VISITS}, d AS (SELECT *, (visit_id % 97 = 0)::INT AS infection_rare FROM visits), x AS (" + " UNION ALL ".join(
    f"""SELECT {i} AS place, '{c}' AS column_name, max(typeof({c})) <> 'VARCHAR' AS numeric,
  var_samp(TRY_CAST({c} AS DOUBLE)) AS spread FROM d""" for i, c in enumerate(_LISTED)) + """), l AS (
  SELECT CASE WHEN numeric THEN 'numeric' ELSE 'strings' END AS list_name, place, column_name FROM x
  UNION ALL SELECT 'low_variance', place, column_name FROM x WHERE numeric AND spread < 0.02)
SELECT list_name, (row_number() OVER (PARTITION BY list_name ORDER BY place) - 1)::INT AS position, column_name FROM l""")
def _(t):
    d = v.visits(t).select("visit_id", "age", "technique", "comorbid", "weight_kg",
                           (F.col("visit_id") % 97 == 0).cast("int").alias("infection_rare"))
    path = files.save_lists(t.spark, {"numeric": cleaning.numeric_columns(d), "strings": cleaning.string_columns(d),
                                      "low_variance": low_variance_columns(d)}, fresh_path(t.spark, "lists"))
    return files.lists_to_state(t.spark, files.load_lists(t.spark, path))


@query("replayed_lists", f"WITH {v.VISITS} SELECT visit_id, age, weight_kg, pain FROM visits")
def _(t):
    lists = {"drop": ["cost", "height_m"], "keep": ["visit_id", "age", "weight_kg", "pain"]}
    path = files.save_lists(t.spark, lists, fresh_path(t.spark, "lists"))
    found = files.load_lists(t.spark, path)
    return co.conform(co.drop_columns(v.visits(t), found["drop"]), found["keep"])


_TABLES = """SELECT '{0}' AS table_name, technique AS group_value, {0}::VARCHAR AS value, count(*) AS n
FROM visits GROUP BY ALL"""


@query("merged_table_collections", f"""WITH {v.VISITS}
{_TABLES.format('pain')} UNION ALL {_TABLES.format('edema').replace('count(*)', '2 * count(*)')}
UNION ALL {_TABLES.format('bleeding')}""")
def _(t):
    d = v.visits(t)
    left = files.save_tables(stacked_crosstabs(d, "technique", ["pain", "edema"]).drop("percentage"),
                             fresh_path(t.spark, "tables"))
    right = stacked_crosstabs(d, "technique", ["edema", "bleeding"]).drop("percentage")
    right = files.save_tables(right.withColumn("n", F.when(F.col("table_name") == "edema", 2 * F.col("n"))
                                               .otherwise(F.col("n"))), fresh_path(t.spark, "tables"))
    return files.merge_tables(files.load_tables(t.spark, left), files.load_tables(t.spark, right))


@query("renamed_columns", f"""WITH {v.CLINICAL} SELECT patient_id, "Age (y)" AS "Age_years",
  "Height (m)" AS "Height_m", "Surgical Technique" AS "Surgical_Technique", "Cost Type" AS "Cost_Type" FROM clinical""")
def _(t):
    d = co.rename_columns(v.clinical(t), co.CLINICAL_NAMES)
    return d.select("patient_id", "Age_years", "Height_m", "Surgical_Technique", "Cost_Type")


@query("columns_by_name", f"""WITH {v.CLINICAL} SELECT "Functional Outcomes (pain)" AS "Functional_Outcomes_Pain",
  "Functional Outcomes (Bleeding)" AS "Functional_Outcomes_Bleeding",
  "Functional Outcomes (Edema)" AS "Functional_Outcomes_Edema",
  "Functional Outcomes (Infection)" AS "Functional_Outcomes_Infection" FROM clinical""")
def _(t):
    d = co.rename_columns(v.clinical(t), co.CLINICAL_NAMES)
    return d.select(*co.columns_matching(d, contains="Functional_"))


@query("columns_by_type", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    return t.orders.select(*co.columns_by_type(t.orders, "numeric"))


@query("columns_by_cardinality", f"WITH {v.VISITS} SELECT visit_id, age, cost, weight_kg, height_m FROM visits")
def _(t):
    d = v.visits(t).drop("person_id")
    return d.select(*co.columns_with_more_values(d, 2))


@query("dropped_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def _(t):
    return co.drop_columns(t.orders, ["o_totalprice", "o_orderpriority", "o_totalprice"])


@query("features_of_split", f"WITH {v.ML} SELECT * EXCLUDE (y) FROM ml")
def _(t):
    return co.split_features_label(v.ml(t), "vec_id", "y")[0]


@query("labels_of_split", f"WITH {v.ML} SELECT vec_id, y FROM ml")
def _(t):
    return co.split_features_label(v.ml(t), "vec_id", "y")[1]


@query("conformed_columns", f"WITH {v.VISITS} SELECT visit_id, weight_kg, age, 0 AS technique_Unseen FROM visits")
def _(t):
    return co.conform(v.visits(t), ["weight_kg", "age", "technique_Unseen"], "visit_id", fill_missing=0)


@query("anonymous_ids", """WITH ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5(concat(o_orderkey, ':222')), o_orderkey) - 1 AS k FROM orders)
SELECT 100000000 + ((k::HUGEINT * 40353607 + 222) % 900000000)::BIGINT AS patient_id, o_orderkey, o_totalprice
FROM ranked""")
def _(t):
    return co.add_ids(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("recoded_values", f"""WITH {v.CLINICAL}
SELECT patient_id, CASE "Geographical Origin" WHEN 'Marocco' THEN 'Morocco' ELSE "Geographical Origin" END AS origin,
  CASE "Functional Outcomes (pain)" WHEN 1 THEN 'Pain' END AS pain FROM clinical""")
def _(t):
    d = v.clinical(t).select("patient_id", F.col("Geographical Origin").alias("origin"),
                             F.col("Functional Outcomes (pain)").alias("pain"))
    return co.with_mapped(co.with_mapped(d, "origin", cl.ORIGIN_SPELLING, True), "pain", {1: "Pain"}, False)


@query("compared_cells", f"""WITH {v.VISITS}, b AS (
  SELECT visit_id, CASE WHEN visit_id % 50 = 0 THEN NULL ELSE age END AS age,
    CASE WHEN visit_id % 70 = 0 THEN 'Other' ELSE technique END AS technique, height_m
  FROM visits WHERE visit_id % 90 <> 1), j AS (
  SELECT coalesce(a.visit_id, b.visit_id) AS key, a.age AS a1, b.age AS b1, a.technique AS a2, b.technique AS b2,
    a.height_m AS a3, b.height_m AS b3, b.visit_id IS NULL AS alone
  FROM visits a FULL JOIN b ON a.visit_id = b.visit_id)
SELECT key, 'age' AS column_name, a1::VARCHAR AS left_value, b1::VARCHAR AS right_value FROM j
WHERE alone OR a1 IS DISTINCT FROM b1
UNION ALL SELECT key, 'technique', a2, b2 FROM j WHERE alone OR a2 IS DISTINCT FROM b2
UNION ALL SELECT key, 'height_m', a3::VARCHAR, b3::VARCHAR FROM j WHERE alone OR a3 IS DISTINCT FROM b3""")
def _(t):
    a = v.visits(t).select("visit_id", "age", "technique", "height_m")
    k = F.col("visit_id")
    b = a.filter(k % 90 != 1).select(
        k, F.when(k % 50 != 0, F.col("age")).alias("age"),
        F.when(k % 70 == 0, "Other").otherwise(F.col("technique")).alias("technique"), "height_m")
    return cell_differences(a, b, "visit_id")


@query("latest_runs", f"""WITH {v.RUNS}
SELECT experiment, run_name, arg_max(run_id, (start_time, run_id)) AS run_id, max(start_time) AS start_time,
  count(*) AS n_runs FROM runs GROUP BY ALL""")
def _(t):
    return registry.latest_runs(v.runs(t))


@query("logged_metrics", f"""WITH {v.RUNS}, n AS (SELECT count(*)::DOUBLE AS n, min(value) AS low FROM runs)
SELECT run_id, 'score' AS metric, value, 0::BIGINT AS step FROM runs
UNION ALL SELECT run_id, 'double score', 2 * value, 1 FROM runs
UNION ALL SELECT 'all', 'runs', n, 2 FROM n UNION ALL SELECT 'all', 'low', low, 2 FROM n""")
def _(t):
    path = fresh_path(t.spark, "registry")
    d = v.runs(t)
    registry.append_metrics(d.select("run_id", F.lit("score").alias("metric"), "value"), path, F.current_timestamp())
    registry.append_metrics(d.select("run_id", F.lit("double score").alias("metric"), (2 * F.col("value")).alias("value")),
                            path, F.current_timestamp(), 1)
    total = d.agg(F.count(F.lit(1)).alias("runs"), F.min("value").alias("low")).first()
    registry.log_metrics(t.spark, path, "all", total.asDict(), 2)
    return registry.read_table(t.spark, path, "run_metrics").drop("logged_at")


@query("best_runs", f"""WITH {v.RERUNS}, hi AS (SELECT 'max' AS mode, * FROM runs WHERE experiment = 'click'
  ORDER BY value DESC NULLS LAST, start_time DESC, run_id DESC LIMIT 1), lo AS (
  SELECT 'min' AS mode, * FROM runs WHERE experiment = 'click'
  ORDER BY value ASC NULLS LAST, start_time DESC, run_id DESC LIMIT 1)
SELECT mode, experiment, run_id, run_name, split_part(run_name, '_', 1) AS estimator, value
FROM (SELECT * FROM hi UNION ALL SELECT * FROM lo)""")
def _(t):
    d = v.runs(t)
    # half of the runs are logged again an hour later, with another value
    first = registry.metric_rows(d.select("run_id", F.lit("score").alias("metric"), "value", "start_time"), F.col("start_time"))
    again = registry.metric_rows(d.filter(F.col("run_id").cast("bigint") % 2 == 0).select(
        "run_id", F.lit("score").alias("metric"), (100 - F.col("value")).alias("value"), "start_time"),
        F.col("start_time") + F.expr("interval 1 hour"), 1)
    metrics = first.unionByName(again)
    out = None
    for mode in ("max", "min"):
        one = registry.best_run_table(d.drop("value"), metrics, "click", "score", mode).select(
            F.lit(mode).alias("mode"), "*")
        out = one if out is None else out.unionByName(one)
    return out


_FILTERED = f"WITH {v.CLINICAL}, adult AS (SELECT * FROM clinical WHERE \"Age (y)\"::BIGINT >= 18)"


def _bmi() -> str:
    return 'round_even("Weight (Kg)" / ("Height (m)" * "Height (m)") * 1e2, 0) / 1e2'


def _map(column: str) -> str:
    s, d = f"split_part({column}, '/', 1)::DOUBLE", f"split_part({column}, '/', 2)::DOUBLE"
    return f"round_even(({d} + ({s} - {d}) / 3e0) * 1e2, 0) / 1e2"


@query("model_ready_features", f"""{_FILTERED}, b AS (SELECT *, {_bmi()} AS "BMI" FROM adult), c AS (
  SELECT *, CASE WHEN "BMI" < 18.5 THEN 'U' WHEN "BMI" >= 18.5 AND "BMI" < 24.9 THEN 'N'
    WHEN "BMI" >= 25 AND "BMI" < 29.9 THEN 'O' ELSE 'X' END AS cat,
    "Intraoperative Mean Blood Pressure (mmHg)" AS bp FROM b)
SELECT patient_id, "Age (y)"::BIGINT AS "Age_years",
  CASE WHEN "Surgical Technique" = 'Traditional' THEN 0 ELSE 1 END AS "Surgical_Technique",
  "Intraoperative Blood Loss (ml)" AS "Intraoperative_Blood_Loss_ml", "Surgical Time (min)"::BIGINT AS "Surgical_Time_min",
  "BMI", split_part(bp, '/', 1)::DOUBLE AS "Intraop_SBP", split_part(bp, '/', 2)::DOUBLE AS "Intraop_DBP",
  (contains(upper("Comorbidities"), 'DM'))::INT AS "Diabetes", (cat = 'X')::INT AS "BMI_Category_Obese",
  (cat = 'O')::INT AS "BMI_Category_Overweight", (cat = 'U')::INT AS "BMI_Category_Underweight",
  ("Functional Outcomes (Bleeding)" | "Functional Outcomes (Edema)" | "Functional Outcomes (pain)"
    | "Functional Outcomes (Infection)") AS "Bleeding_Edema_Outcome" FROM c""")
def _(t):
    raw = v.clinical(t)
    state = cl.fit_clinical(raw)
    path = state.save(fresh_path(t.spark, "clinical"))
    return cl.apply_clinical(raw, cl.ClinicalState.load(t.spark, path))


@query("exploratory_cohort", f"""{_FILTERED}
SELECT patient_id, {_bmi()} AS "BMI", {_map('"Preoperative Blood Pressure (mmHg)"')} AS "Preop_MAP",
  {_map('"Intraoperative Mean Blood Pressure (mmHg)"')} AS "Intraop_MAP",
  CASE WHEN TRY_CAST("Comorbidities" AS DOUBLE) = 0 THEN 0 ELSE 1 END AS "Comorbidity_Flag",
  "Cost of Procedure (€)" AS "Cost_of_Procedure_euros",
  CASE "Geographical Origin" WHEN 'Marocco' THEN 'Morocco' ELSE "Geographical Origin" END AS "Geographical_Origin"
FROM adult""")
def _(t):
    raw = v.clinical(t)
    state = cl.fit_clinical(raw)
    eda, model = fresh_path(t.spark, "eda"), fresh_path(t.spark, "model")
    cl.write_cohort(raw, state, eda, model)
    return t.spark.read.parquet(eda).select(
        "patient_id", "BMI", "Preop_MAP", "Intraop_MAP", "Comorbidity_Flag", "Cost_of_Procedure_euros",
        "Geographical_Origin")


_LINEAR = "1e0 / (1e0 + exp(-(-2e0 + 3e0 * signal + 1e0 * noise)))"


@query("streamed_scores", f"WITH {v.SCORED} SELECT id, {r(_LINEAR)} AS p, ({_LINEAR} > 0.5e0)::INT AS predictions FROM scored")
def _(t):
    source = fresh_path(t.spark, "arriving")
    rows = v.scored(t).select("id", "signal", "noise")
    rows.repartition(4, "id").write.parquet(source)

    def score(d):
        p = 1.0 / (1.0 + F.exp(-(F.lit(-2.0) + 3.0 * F.col("signal") + 1.0 * F.col("noise"))))
        return rounded(d.select("id", p.alias("p"), fx.threshold_class(p, 0.5).alias("predictions")), "p")

    sink = fresh_path(t.spark, "scored")
    score_files(t.spark, source, rows.schema, score, sink, fresh_path(t.spark, "offsets"), 2).awaitTermination()
    return t.spark.read.parquet(sink)


@query("materialized_stage", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    return materialize(t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")), "priorities")
