"""Queries on cohort selection, cleaning and feature derivation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.functions import cleaning, features as fx
from cohortline.operators import cohort, columns as co
from cohortline.plans import views as v
from cohortline.plans.catalog import query, r, rounded


@query("cohort_filter", f"WITH {v.VISITS} SELECT visit_id, age FROM visits WHERE age >= 18")
def _(t):
    return cohort.minimum_filter(v.visits(t).select("visit_id", "age"), "age", 18)


@query("arm_outcome_filter", f"""WITH {v.SCORED} SELECT y, count(*) AS n FROM scored
WHERE arm = 'Laser' AND signal >= 0.24 GROUP BY ALL""")
def _(t):
    return cohort.arm_outcome_filter(v.scored(t), {"arm": "Laser"}, "signal", 0.24).groupBy("y").agg(
        F.count("*").alias("n"))


@query("arm_outcome_class_filter", f"""WITH {v.SCORED} SELECT id FROM scored
WHERE arm = 'Traditional' AND y = 1 AND (signal > 0.5)::INT > 0.24""")
def _(t):
    d = v.scored(t).withColumn("y_pred", fx.threshold_class(F.col("signal"), 0.5))
    return cohort.arm_outcome_filter(d, {"arm": "Traditional", "y": 1}).filter("y_pred > 0.24D").select("id")


@query("excluded_values", f"""WITH {v.VISITS} SELECT visit_id, comorbid FROM visits
WHERE comorbid IS NULL OR comorbid NOT IN ('0', 'HTN')""")
def _(t):
    return cohort.exclude_values(v.visits(t).select("visit_id", "comorbid"), "comorbid", ["0", "HTN"])


@query("cohort_flow", f"""WITH {v.VISITS}, n AS (SELECT count(*) AS a, count(*) FILTER (age < 18) AS b,
  count(*) FILTER (age >= 18) AS c, count(*) FILTER (age >= 18 AND technique = 'Traditional') AS d,
  count(*) FILTER (age >= 18 AND technique = 'Laser') AS e FROM visits)
SELECT 0 AS position, 'evaluated' AS step, a AS n FROM n UNION ALL SELECT 1, 'excluded', b FROM n
UNION ALL SELECT 2, 'cohort', c FROM n UNION ALL SELECT 3, 'traditional', d FROM n
UNION ALL SELECT 4, 'laser', e FROM n""")
def _(t):
    adult = F.col("age") >= 18
    return cohort.cohort_flow(v.visits(t), {
        "evaluated": F.lit(True), "excluded": ~adult, "cohort": adult,
        "traditional": adult & (F.col("technique") == "Traditional"),
        "laser": adult & (F.col("technique") == "Laser")})


_NULLED = "CASE WHEN {0} <> '' AND NOT regexp_matches({0}, '-{{2,}}') AND NOT regexp_matches({0}, '[.]{{2,}}') THEN {0} END"
_AMOUNT = _NULLED.format("amount")


@query("null_tokens", f"WITH {v.RAW_STRINGS} SELECT id, {_AMOUNT} AS amount, {_NULLED.format('numeric_text')} AS "
       "numeric_text, integer_text, one_bad, typed_text FROM raw_strings")
def _(t):
    return cleaning.normalize_null_tokens(v.raw_strings(t))


@query("thousand_separators", f"WITH {v.RAW_STRINGS} SELECT id, TRY_CAST(replace({_AMOUNT}, ',', '') AS DOUBLE) AS "
       "amount FROM raw_strings")
def _(t):
    return v.raw_strings(t).select("id", cleaning.thousands_to_number(cleaning.null_tokens(F.col("amount")))
                                   .alias("amount"))


@query("cleaned_table", f"""WITH {v.RAW_STRINGS} SELECT id, TRY_CAST(replace({_AMOUNT}, ',', '') AS DOUBLE) AS amount,
  CASE WHEN numeric_text <> '--' THEN numeric_text::DOUBLE END AS numeric_text,
  integer_text::BIGINT AS integer_text, one_bad, typed_text FROM raw_strings""")
def _(t):
    return cleaning.clean_dataframe(v.raw_strings(t), ["amount"])


_TEXTS = ("amount", "numeric_text", "integer_text", "one_bad", "typed_text")


@query("numeric_inference", f"WITH {v.RAW_STRINGS}, x AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS n, count(nullif({c}, '')) AS present, count(TRY_CAST({c} AS DOUBLE)) AS numbers,
  count(*) FILTER (regexp_full_match({c}, '[+-]?[0-9]+')) AS whole FROM raw_strings""" for c in _TEXTS)
    + """) SELECT column_name, CASE WHEN whole = n THEN 'bigint' ELSE 'double' END AS target_type FROM x
WHERE present > 0 AND numbers = present""")
def _(t):
    return cleaning.fit_numeric(v.raw_strings(t))


@query("coerced_numbers", f"WITH {v.VISITS} SELECT visit_id, TRY_CAST(comorbid AS DOUBLE) AS comorbid FROM visits")
def _(t):
    return v.visits(t).select("visit_id", cleaning.coerce_number(F.col("comorbid")).alias("comorbid"))


@query("filled_values", f"""WITH {v.VISITS} SELECT visit_id, coalesce(height_m, -1) AS height_m,
  coalesce(comorbid, 'none') AS comorbid, bp FROM visits""")
def _(t):
    d = v.visits(t).select("visit_id", "height_m", "comorbid", "bp")
    return cleaning.handle_missing_values(cleaning.handle_missing_values(
        cleaning.handle_missing_values(d, ["height_m"], -1.0), ["comorbid"], "none"), ["bp"])


@query("display_placeholder", f"WITH {v.VISITS} SELECT visit_id, coalesce(comorbid, '-') AS comorbid FROM visits")
def _(t):
    return v.visits(t).select("visit_id", cleaning.placeholder(F.col("comorbid")).alias("comorbid"))


@query("converted_units", f"""WITH {v.VISITS} SELECT visit_id, {r('weight_kg * 2.2 * 0.45359237e0')} AS kg,
  {r('height_m * 40 * 0.0254e0')} AS metres, {r('height_m * 100 / 100e0')} AS metres_from_cm FROM visits""")
def _(t):
    d = v.visits(t).select("visit_id", fx.to_kg(F.col("weight_kg") * 2.2, "lbs").alias("kg"),
                           fx.to_metres(F.col("height_m") * 40, "in").alias("metres"),
                           fx.to_metres(F.col("height_m") * 100, "cm").alias("metres_from_cm"))
    return rounded(d, "kg", "metres", "metres_from_cm")


_BMI = "round_even(weight_kg / (height_m * height_m) * 1e2, 0) / 1e2"


@query("body_mass_index", f"WITH {v.VISITS} SELECT visit_id, {_BMI} AS \"BMI\" FROM visits")
def _(t):
    return fx.calculate_bmi(v.visits(t), "weight_kg", "height_m").select("visit_id", "BMI")


_CATEGORY = """CASE WHEN bmi < 18.5 THEN 'Underweight' WHEN bmi >= 18.5 AND bmi < 24.9 THEN 'Normal_Weight'
  WHEN bmi >= 25 AND bmi < 29.9 THEN 'Overweight' ELSE 'Obese' END"""


@query("body_mass_category", f"""WITH {v.VISITS}, b AS (SELECT visit_id, {_BMI} AS bmi FROM visits)
SELECT visit_id, {_CATEGORY} AS category, CASE WHEN bmi < 18.5 THEN 'Underweight' WHEN bmi < 25 THEN 'Normal_Weight'
  WHEN bmi < 30 THEN 'Overweight' WHEN bmi >= 30 THEN 'Obese' END AS closed_category FROM b""")
def _(t):
    d = fx.calculate_bmi(v.visits(t), "weight_kg", "height_m")
    return d.select("visit_id", fx.bmi_category(F.col("BMI")).alias("category"),
                    fx.bmi_category(F.col("BMI"), "who").alias("closed_category"))


@query("split_pressure", f"""WITH {v.VISITS} SELECT visit_id, TRY_CAST(split_part(bp, '/', 1) AS DOUBLE) AS "SBP",
  TRY_CAST(split_part(bp, '/', 2) AS DOUBLE) AS "DBP" FROM visits""")
def _(t):
    return fx.split_bp_column(v.visits(t), "bp").select("visit_id", "SBP", "DBP")


@query("mean_pressure", f"""WITH {v.VISITS}, p AS (SELECT visit_id, TRY_CAST(split_part(bp, '/', 1) AS DOUBLE) AS s,
  TRY_CAST(split_part(bp, '/', 2) AS DOUBLE) AS d FROM visits)
SELECT visit_id, round_even((d + (s - d) / 3e0) * 1e2, 0) / 1e2 AS "MAP",
  round_even((d + (s - d) / 3e0) * 1e2, 0) / 1e2 AS from_parts FROM p""")
def _(t):
    d = fx.calculate_map(v.visits(t), combined_bp_col="bp", on_error="null")
    d = fx.calculate_map(fx.split_bp_column(d, "bp"), "from_parts", "SBP", "DBP")
    return d.select("visit_id", "MAP", "from_parts")


@query("encoded_technique", f"""WITH {v.VISITS}
SELECT visit_id, CASE WHEN technique = 'Traditional' THEN 0 ELSE 1 END AS technique FROM visits""")
def _(t):
    return v.visits(t).select("visit_id", fx.binary_encode(F.col("technique"), "Traditional").alias("technique"))


@query("comorbidity_flag", f"""WITH {v.VISITS}
SELECT visit_id, CASE WHEN TRY_CAST(comorbid AS DOUBLE) = 0 THEN 0 ELSE 1 END AS flag FROM visits""")
def _(t):
    return v.visits(t).select("visit_id", fx.presence_flag(F.col("comorbid")).alias("flag"))


@query("diabetes_flag", f"""WITH {v.VISITS}
SELECT visit_id, coalesce(contains(lower(comorbid), 'dm'), false)::INT AS diabetes FROM visits""")
def _(t):
    return v.visits(t).select("visit_id", fx.mention_flag(F.col("comorbid"), "DM").alias("diabetes"))


@query("composite_outcome", f"""WITH {v.VISITS}
SELECT visit_id, (pain + bleeding + edema + infection > 0)::INT AS outcome FROM visits""")
def _(t):
    return v.visits(t).select("visit_id", fx.any_flag(*[F.col(c) for c in ("pain", "bleeding", "edema", "infection")])
                              .alias("outcome"))


def band_sql(column: str, closed: str) -> str:
    """CASE over the default age bands."""
    out = []
    for lo, hi, name in zip(fx.AGE_EDGES, fx.AGE_EDGES[1:], fx.band_labels(fx.AGE_EDGES)):
        test = f"{column} > {lo} AND {column} <= {hi}" if closed == "right" else f"{column} >= {lo} AND {column} < {hi}"
        out.append(f"WHEN {test} THEN '{name}'")
    return "CASE " + " ".join(out) + " END"


@query("bands_closed_right", f"""WITH {v.VISITS}
SELECT visit_id, age + 8 AS age, {band_sql('(age + 8)', 'right')} AS band FROM visits""")
def _(t):
    d = v.visits(t).select("visit_id", (F.col("age") + 8).alias("age"))
    return d.withColumn("band", fx.band(F.col("age")))


@query("bands_closed_left", f"""WITH {v.VISITS}
SELECT visit_id, age + 8 AS age, {band_sql('(age + 8)', 'left')} AS band FROM visits""")
def _(t):
    d = v.visits(t).select("visit_id", (F.col("age") + 8).alias("age"))
    return d.withColumn("band", fx.band(F.col("age"), closed="left"))


@query("one_hot_columns", f"""WITH {v.VISITS} SELECT visit_id, technique, comorbid,
  (technique = 'Laser')::INT AS "technique_Laser", (technique = 'Traditional')::INT AS "technique_Traditional",
  coalesce(comorbid = '0', false)::INT AS "comorbid_0", coalesce(comorbid = 'DM2', false)::INT AS "comorbid_DM2",
  coalesce(comorbid = 'HTN', false)::INT AS "comorbid_HTN",
  coalesce(comorbid = 'htn, dm', false)::INT AS "comorbid_htn, dm" FROM visits""")
def _(t):
    d = v.visits(t).select("visit_id", "technique", "comorbid")
    return co.apply_one_hot(d, co.fit_one_hot(d, ["technique", "comorbid"]))


@query("stratified_other", f"""WITH {v.VISITS} SELECT visit_id, pain, greatest(edema, infection) AS other,
  CASE WHEN age > 0 AND age <= 30 THEN '(0, 30]' WHEN age > 30 AND age <= 60 THEN '(30, 60]' ELSE 'Unknown' END AS band
FROM visits""")
def _(t):
    return fx.create_stratified_other_column(v.visits(t), ["pain"], ["edema", "infection"], "other", "visit_id",
                                             "age", "band", [0, 30, 60])


@query("threshold_classes", f"WITH {v.SCORED} SELECT id, (signal > 0.6e0)::INT AS y_pred FROM scored")
def _(t):
    return v.scored(t).select("id", fx.threshold_class(F.col("signal"), 0.6).alias("y_pred"))


@query("confusion_flags", f"""WITH {v.SCORED}, p AS (SELECT id, y, signal > 0.5e0 AS c FROM scored)
SELECT id, (y = 1 AND c)::INT AS "TP", (y = 1 AND NOT c)::INT AS "FN", (y = 0 AND c)::INT AS "FP",
  (y = 0 AND NOT c)::INT AS "TN" FROM p""")
def _(t):
    flags = fx.confusion_flags(F.col("y"), fx.threshold_class(F.col("signal"), 0.5))
    return v.scored(t).select("id", *[c.alias(n) for n, c in flags.items()])
