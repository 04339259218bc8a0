"""Queries on counts, group summaries, cross tables, distributions, correlations and baseline tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from cohortline.functions import features as fx
from cohortline.functions.cleaning import placeholder
from cohortline.operators import correlate, crosstab as ct, describe as de, distribution as di, tableone
from cohortline.plans import views as v
from cohortline.plans.catalog import query, r, rounded
from cohortline.plans.preparing import band_sql
from cohortline.session import small_table

LABELS = fx.band_labels(fx.AGE_EDGES)
BANDED = v.VISITS + f", banded AS (SELECT *, {band_sql('age', 'left')} AS band FROM visits)"


def banded(t):
    return v.visits(t).withColumn("band", fx.band(F.col("age"), closed="left"))


@query("value_counts", f"WITH {v.VISITS} SELECT comorbid AS value, count(*) AS count FROM visits "
       "WHERE comorbid IS NOT NULL GROUP BY 1")
def _(t):
    return de.value_counts(v.visits(t), "comorbid")


@query("value_shares", f"""WITH {v.VISITS} SELECT comorbid AS value, count(*) AS count,
  {r('100e0 * count(*) / sum(count(*)) OVER ()')} AS percentage FROM visits WHERE comorbid IS NOT NULL GROUP BY 1""")
def _(t):
    return rounded(de.value_shares(v.visits(t), "comorbid"), "percentage")


@query("top_values", f"""WITH {v.VISITS} SELECT age AS value FROM visits GROUP BY 1 ORDER BY count(*) DESC, age LIMIT 5""")
def _(t):
    return de.top_n(v.visits(t), "age", 5)


@query("group_means", f"WITH {v.PLACED} SELECT origin AS group_value, {r('avg(cost)')} AS mean FROM placed GROUP BY 1")
def _(t):
    return rounded(de.group_mean(v.placed(t), "origin", "cost", ascending=False), "mean")


@query("group_summaries", f"""WITH {BANDED}, bm AS (
  SELECT band, round_even(weight_kg / (height_m * height_m) * 1e2, 0) / 1e2 AS bmi, cost FROM banded WHERE band IS NOT NULL)
SELECT band AS group_value, 'BMI' AS variable, {r('avg(bmi)')} AS mean, {r('stddev_samp(bmi)')} AS std,
  min(bmi) AS min, max(bmi) AS max FROM bm GROUP BY 1
UNION ALL SELECT band, 'cost', {r('avg(cost)')}, {r('stddev_samp(cost)')}, min(cost), max(cost) FROM bm GROUP BY 1""")
def _(t):
    d = fx.calculate_bmi(banded(t), "weight_kg", "height_m")
    return rounded(de.group_summary(d, "band", ["BMI", "cost"]), "mean", "std")


@query("group_summary_display", f"""WITH {v.VISITS} SELECT person_id AS group_value,
  coalesce(CASE WHEN stddev_samp(cost) IS NOT NULL THEN 'many' END, '-') AS spread FROM visits GROUP BY 1""")
def _(t):
    d = de.group_summary(v.visits(t), "person_id", ["cost"])
    return d.select("group_value", placeholder(F.when(F.col("std").isNotNull(), "many")).alias("spread"))


@query("group_totals", f"""WITH {v.VISITS} SELECT cost_type AS group_value, {r('sum(cost)', 2)} AS total,
  {r('avg(cost)', 2)} AS mean FROM visits GROUP BY 1""")
def _(t):
    return de.group_totals(v.visits(t), "cost_type", "cost")


@query("scores_by_outcome", f"""WITH {v.VISITS}, l AS (
  SELECT 'pain' AS g, pain AS c, cost, weight_kg FROM visits UNION ALL
  SELECT 'edema', edema, cost, weight_kg FROM visits), s AS (
  SELECT g, c, 'cost' AS score, sum(cost) AS sm, avg(cost) AS mn FROM l GROUP BY ALL UNION ALL
  SELECT g, c, 'weight_kg', sum(weight_kg), avg(weight_kg) FROM l GROUP BY ALL), u AS (
  SELECT g, c, score, 'sum' AS statistic, sm AS x FROM s UNION ALL SELECT g, c, score, 'mean', mn FROM s), w AS (
  SELECT g AS grouping, score, statistic, max(x) FILTER (c = 0) AS a, max(x) FILTER (c = 1) AS b FROM u GROUP BY ALL)
SELECT grouping, score, statistic, {r('a', 2)} AS class_0, {r('b', 2)} AS class_1, {r('a + b', 2)} AS "Total",
  {r('a / (a + b)')} AS "No Death Percent", {r('b / (a + b)')} AS "Death Percent",
  {r('(a / (a + b) + b / (a + b)) * 100')} AS "Total Percent" FROM w""")
def _(t):
    d = v.visits(t)
    out = ct.aggregate_scores_by_groups(d.select("visit_id", "cost", "weight_kg"),
                                        d.select("visit_id", "pain", "edema"), "visit_id",
                                        ["cost", "weight_kg"], ["pain", "edema"])
    return rounded(rounded(out, "class_0", "class_1", "Total", digits=2),
                   "No Death Percent", "Death Percent", "Total Percent")


_CELLS = ", ".join(f"count(*) FILTER (band = '{b}') AS \"{b}\"" for b in LABELS)


@query("cross_table", f"""WITH {BANDED} SELECT comorbid AS row_value, {_CELLS} FROM banded
WHERE comorbid IS NOT NULL AND band IS NOT NULL GROUP BY 1""")
def _(t):
    return ct.crosstab(banded(t), "comorbid", "band", LABELS)


@query("cross_table_long", f"""WITH {v.VISITS} SELECT person_id AS row_value, cost_type AS col_value, count(*) AS n
FROM visits GROUP BY ALL""")
def _(t):
    return ct.crosstab_long(v.visits(t), "person_id", "cost_type")


@query("cross_table_margins", f"""WITH {BANDED} SELECT coalesce(comorbid, 'Total') AS row_value, {_CELLS},
  count(*) AS "Total" FROM banded WHERE comorbid IS NOT NULL AND band IS NOT NULL GROUP BY ROLLUP (comorbid)""")
def _(t):
    return ct.crosstab_margins(banded(t), "comorbid", "band", LABELS)


@query("cross_table_shares", f"""WITH {v.VISITS} SELECT technique AS row_value,
  {r('count(*) FILTER (pain = 0) / count(*)')} AS "0", {r('count(*) FILTER (pain = 1) / count(*)')} AS "1"
FROM visits GROUP BY 1""")
def _(t):
    return rounded(ct.crosstab_row_shares(v.visits(t), "technique", "pain", [0, 1]), "0", "1")


@query("cross_table_fixed_order", f"""WITH {BANDED} SELECT comorbid AS row_value, {_CELLS}, NULL::BIGINT AS "100-109"
FROM banded WHERE comorbid <> '0' AND band IS NOT NULL GROUP BY 1""")
def _(t):
    return ct.crosstab_reindexed(banded(t).filter("comorbid <> '0'"), "comorbid", "band", [*LABELS, "100-109"])


_OUTCOMES = ("pain", "bleeding", "edema", "infection")
_STACK = " UNION ALL ".join(f"SELECT '{o}' AS table_name, band AS group_value, {o}::VARCHAR AS value FROM banded "
                            "WHERE band IS NOT NULL" for o in _OUTCOMES)


@query("stacked_cross_tables", f"""WITH {BANDED}, l AS ({_STACK})
SELECT table_name, group_value, value, count(*) AS n,
  {r('100e0 * count(*) / sum(count(*)) OVER (PARTITION BY table_name, group_value)')} AS percentage FROM l
GROUP BY table_name, group_value, value""")
def _(t):
    return rounded(ct.stacked_crosstabs(banded(t), "band", _OUTCOMES), "percentage")


@query("legend_counts", f"""WITH {v.VISITS}, l AS (SELECT 'technique' AS variable, technique AS value FROM visits
  UNION ALL SELECT 'comorbid', comorbid FROM visits)
SELECT variable, value, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY variable)')} AS proportion
FROM l WHERE value IS NOT NULL GROUP BY variable, value""")
def _(t):
    return rounded(ct.legend_counts(v.visits(t), ["technique", "comorbid"]), "proportion")


def _described(c: str) -> str:
    q = ", ".join(f"{r(f'quantile_cont({c}, {p})')} AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75))
    return (f"SELECT '{c}' AS variable, count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, "
            f"min({c})::DOUBLE AS min, {q}, max({c})::DOUBLE AS max FROM visits")


@query("described_columns", f"WITH {v.VISITS} " + " UNION ALL ".join(_described(c) for c in ("age", "cost", "height_m")))
def _(t):
    return rounded(de.describe(v.visits(t), ["age", "cost", "height_m"]), "mean", "std", "q25", "q50", "q75")


def _profiled(c: str, dtype: str) -> str:
    return f"""SELECT '{c}' AS column_name, '{dtype}' AS dtype, count(*) FILTER ({c} IS NULL) AS null_total,
  {r(f'100e0 * count(*) FILTER ({c} IS NULL) / count(*)', 2)} AS null_percentage, count(DISTINCT {c}) AS unique_values,
  (SELECT {c}::VARCHAR FROM visits WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c}::VARCHAR LIMIT 1)
    AS max_unique_value,
  (SELECT count(*) FROM visits WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1)
    AS max_unique_value_total FROM visits"""


@query("column_profile", f"WITH {v.VISITS} " + " UNION ALL ".join(
    _profiled(c, d) for c, d in (("visit_id", "bigint"), ("age", "bigint"), ("technique", "string"),
                                 ("comorbid", "string"), ("bp", "string"), ("pain", "int"))))
def _(t):
    return de.dataframe_profiler(v.visits(t).select("visit_id", "age", "technique", "comorbid", "bp", "pain"))


_VARIED = ("age", "cost", "weight_kg", "height_m", "infection")


@query("column_variances", f"WITH {v.VISITS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {r(f'var_samp({c}) / 1e4')} AS variance FROM visits" for c in _VARIED))
def _(t):
    d = de.column_variances(v.visits(t), _VARIED)
    return rounded(d.withColumn("variance", F.col("variance") / 1e4), "variance")


@query("low_variance_columns", f"""WITH {v.VISITS}, x AS (
  SELECT 'age' AS column_name, var_samp(age) AS s FROM visits UNION ALL
  SELECT 'rare', var_samp((visit_id % 97 = 0)::INT) FROM visits UNION ALL
  SELECT 'constant', var_samp(visit_id * 0) FROM visits)
SELECT column_name FROM x WHERE s < 0.02""")
def _(t):
    d = v.visits(t).select("age", (F.col("visit_id") % 97 == 0).cast("int").alias("rare"),
                           (F.col("visit_id") * 0).alias("constant"))
    return small_table(t.spark, [(c,) for c in de.low_variance_columns(d)], "column_name string")


_NUM = ("age", "cost", "weight_kg", "height_m", "pain")


@query("correlations", f"WITH {v.VISITS} " + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {r(f'corr({a}, {b})')} AS r FROM visits"
    for i, a in enumerate(_NUM) for b in _NUM[i:]))
def _(t):
    return rounded(correlate.correlations(v.visits(t), _NUM), "r")


@query("wide_correlations", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, "
       "generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) "
       f"SELECT concat('e', a.i) AS x, concat('e', b.i) AS y, {r('corr(a.x, b.x)')} AS r "
       "FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i")
def _(t):
    d = t.embeddings.select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return rounded(correlate.correlations(d), "r")


_FITS = [p for p in combinations(("age", "cost", "weight_kg", "height_m"), 2) if p != ("age", "cost")]


def _fit_sql(group: str) -> str:
    head = f"{group} AS hue_value, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return " UNION ALL ".join(
        f"SELECT {head}'{x}' AS x, '{y}' AS y, regr_count({y}, {x})::BIGINT AS n, {r(f'regr_slope({y}, {x})', 4)} AS slope, "
        f"{r(f'regr_intercept({y}, {x})', 4)} AS intercept, {r(f'corr({x}, {y})')} AS r FROM visits{tail}"
        for x, y in _FITS)


@query("pair_fits", f"WITH {v.VISITS} {_fit_sql('')}")
def _(t):
    pairs = correlate.column_pairs(("age", "cost", "weight_kg", "height_m"), exclude=[("cost", "age")])
    return rounded(rounded(correlate.pair_fits(v.visits(t), pairs), "slope", "intercept", digits=4), "r")


@query("pair_fits_by_group", f"WITH {v.VISITS} {_fit_sql('technique')}")
def _(t):
    pairs = correlate.column_pairs(("age", "cost", "weight_kg", "height_m"), exclude=[("cost", "age")])
    return rounded(rounded(correlate.pair_fits(v.visits(t), pairs, "technique"), "slope", "intercept", digits=4), "r")


@query("histogram", f"""WITH {v.VISITS}, h AS (SELECT least(floor(age / 10), 9)::INT AS bin, count(*) AS n FROM visits
  WHERE age BETWEEN 0 AND 100 GROUP BY 1)
SELECT g::INT AS bin, g * 10e0 AS bin_low, (g + 1) * 10e0 AS bin_high, coalesce(n, 0) AS n,
  {r('coalesce(n, 0) / ((SELECT sum(n) FROM h) * 10e0)', 8)} AS density
FROM generate_series(0, 9) s(g) LEFT JOIN h ON g = bin""")
def _(t):
    return rounded(di.histogram(v.visits(t), "age", 10, 0, 100), "density", digits=8)


@query("histogram_of_range", f"""WITH {v.VISITS}, m AS (SELECT min(cost) AS lo, (max(cost) - min(cost)) / 10 AS w FROM visits),
h AS (SELECT least(floor((cost - lo) / w), 9)::INT AS bin, count(*) AS n FROM visits, m GROUP BY 1)
SELECT g::INT AS bin, {r('lo + g * w')} AS bin_low, {r('lo + (g + 1) * w')} AS bin_high, coalesce(n, 0) AS n,
  {r('coalesce(n, 0) / ((SELECT sum(n) FROM h) * w)', 12)} AS density
FROM generate_series(0, 9) s(g) CROSS JOIN m LEFT JOIN h ON g = bin""")
def _(t):
    return rounded(rounded(di.histogram(v.visits(t), "cost", 10), "bin_low", "bin_high"), "density", digits=12)


@query("kernel_density", f"""WITH {v.VISITS}, a AS (SELECT age::DOUBLE AS v, count(*) AS c FROM visits GROUP BY 1),
m AS (SELECT stddev_samp(age) * pow(count(*), -0.2e0) AS h, count(*) AS n FROM visits)
SELECT g::INT AS point, {r('g * (100e0 / 499)')} AS x,
  {r('sum(c * exp(-0.5e0 * pow((g * (100e0 / 499) - v) / h, 2))) / (sqrt(2 * pi()) * any_value(h) * any_value(n))', 8)} AS density
FROM generate_series(0, 499) s(g) CROSS JOIN a CROSS JOIN m GROUP BY g""")
def _(t):
    return rounded(rounded(di.kernel_density(v.visits(t), "age", 0, 100), "x"), "density", digits=8)


@query("kernel_density_of_prices", f"""WITH a AS (SELECT o_totalprice AS v FROM orders),
m AS (SELECT stddev_samp(v) * pow(count(*), -0.2e0) AS h, count(*) AS n FROM a)
SELECT g::INT AS point, {r('g * (600000e0 / 499)')} AS x,
  {r('1e5 * sum(exp(-0.5e0 * pow((g * (600000e0 / 499) - v) / h, 2))) / (sqrt(2 * pi()) * any_value(h) * any_value(n))', 8)} AS density
FROM generate_series(0, 499) s(g) CROSS JOIN a CROSS JOIN m GROUP BY g""")
def _(t):
    """Nearly every value is a different one; per 100000 of the currency."""
    d = di.kernel_density(t.orders, "o_totalprice", 0, 600000).withColumn("density", 1e5 * F.col("density"))
    return rounded(rounded(d, "x"), "density", digits=8)


def _bands(c: str) -> str:
    lines = [("mean", "avg({0})"), ("median", "median({0})")]
    for k in (1, 2, 3):
        lines += [(f"mean-{k}sd", f"avg({{0}}) - {k} * stddev_samp({{0}})"),
                  (f"mean+{k}sd", f"avg({{0}}) + {k} * stddev_samp({{0}})")]
    return " UNION ALL ".join(f"SELECT '{c}' AS variable, '{n}' AS line, {r(e.format(c))} AS x FROM visits"
                              for n, e in lines)


@query("sigma_bands", f"WITH {v.VISITS} {_bands('age')} UNION ALL {_bands('cost')}")
def _(t):
    return rounded(di.sigma_bands(v.visits(t), ["age", "cost"]), "x")


_BOX_BASE = f"""WITH {BANDED}, l AS (
  SELECT visit_id, band AS group_value, 'cost' AS variable, cost AS v FROM banded WHERE band IS NOT NULL UNION ALL
  SELECT visit_id, band, 'skewed', pow(weight_kg - 40, 4) FROM banded WHERE band IS NOT NULL), q AS (
  SELECT group_value, variable, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c,
    count(*) AS n FROM l GROUP BY ALL), f AS (
  SELECT l.*, n, a, b, c, v < a - 1.5 * (c - a) OR v > c + 1.5 * (c - a) AS o FROM l JOIN q USING (group_value, variable))"""


def _boxed(t):
    return banded(t).withColumn("skewed", F.pow(F.col("weight_kg") - 40, F.lit(4.0)))


@query("box_statistics", f"""{_BOX_BASE} SELECT group_value, variable, any_value(n) AS n, {r('any_value(a)', 3)} AS q1,
  {r('any_value(b)', 3)} AS median, {r('any_value(c)', 3)} AS q3, min(v) FILTER (NOT o) AS whisker_low,
  max(v) FILTER (NOT o) AS whisker_high, count(*) FILTER (o) AS outliers FROM f GROUP BY ALL""")
def _(t):
    return rounded(di.box_stats(_boxed(t), "band", ["cost", "skewed"]), "q1", "median", "q3", digits=3)


@query("box_outliers", f"{_BOX_BASE} SELECT visit_id, group_value, variable, v FROM f WHERE o")
def _(t):
    return di.box_outliers(_boxed(t), "band", ["cost", "skewed"], "visit_id")


_CONT = ("age", "cost", "height_m")


def _continuous(c: str) -> str:
    by = ", ".join(f"count({c}) FILTER (pain = {g}) AS n_{g}, {r(f'avg({c}) FILTER (pain = {g})')} AS mean_{g}, "
                   f"{r(f'stddev_samp({c}) FILTER (pain = {g})')} AS sd_{g}" for g in (0, 1))
    m = [(f"count({c}) FILTER (pain = {g})", f"avg({c}) FILTER (pain = {g})", f"var_samp({c}) FILTER (pain = {g})")
         for g in (0, 1)]
    e = [f"({s} / {n})" for n, _, s in m]
    t = f"({m[0][1]} - {m[1][1]}) / sqrt({e[0]} + {e[1]})"
    dof = (f"pow({e[0]} + {e[1]}, 2) / (pow({e[0]}, 2) / ({m[0][0]} - 1) + pow({e[1]}, 2) / ({m[1][0]} - 1))")
    return f"""SELECT '{c}' AS variable, count({c}) AS n, count(*) FILTER ({c} IS NULL) AS missing_n,
  {r(f'100e0 * count(*) FILTER ({c} IS NULL) / count(*)')} AS missing_pct, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS sd,
  min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, {by},
  (SELECT {c}::DOUBLE FROM visits WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode,
  {r(f'median({c})')} AS median, {r(t)} AS t, {r(dof, 3)} AS dof FROM visits"""


@query("baseline_continuous", f"WITH {v.VISITS} " + " UNION ALL ".join(_continuous(c) for c in _CONT))
def _(t):
    d = tableone.continuous_table(v.visits(t), _CONT, "pain", p_value=False)
    return rounded(rounded(d, "missing_pct", "mean", "sd", "mean_0", "sd_0", "mean_1", "sd_1", "median", "t"),
                   "dof", digits=3)


def _t_tail(t: str, dof: str) -> str:
    """Two-sided tail of Student's t by Simpson's rule over 0..|t| with 2000 intervals."""
    density = f"pow(1 + pow(abs({t}) * g / 2000e0, 2) / {dof}, -({dof} + 1) / 2)"
    norm = f"exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2)) / sqrt({dof} * pi())"
    weight = "CASE WHEN g IN (0, 2000) THEN 1 WHEN g % 2 = 1 THEN 4 ELSE 2 END"
    return f"1 - 2 * {norm} * abs({t}) / 6000 * (SELECT sum({weight} * {density}) FROM generate_series(0, 2000) s(g))"


@query("baseline_p_values", f"""WITH {v.VISITS}, l AS (SELECT pain, 'age' AS variable, age::DOUBLE AS v FROM visits
  UNION ALL SELECT pain, 'cost', cost FROM visits UNION ALL SELECT pain, 'height_m', height_m FROM visits), m AS (
  SELECT variable, count(v) FILTER (pain = 0) AS n0, count(v) FILTER (pain = 1) AS n1,
    avg(v) FILTER (pain = 0) AS m0, avg(v) FILTER (pain = 1) AS m1,
    var_samp(v) FILTER (pain = 0) / count(v) FILTER (pain = 0) AS e0,
    var_samp(v) FILTER (pain = 1) / count(v) FILTER (pain = 1) AS e1 FROM l GROUP BY 1), s AS (
  SELECT variable, (m0 - m1) / sqrt(e0 + e1) AS t,
    pow(e0 + e1, 2) / (pow(e0, 2) / (n0 - 1) + pow(e1, 2) / (n1 - 1)) AS dof FROM m)
SELECT variable, {r(_t_tail('t', 'dof'), 5)} AS p_value FROM s""")
def _(t):
    d = tableone.continuous_table(v.visits(t), _CONT, "pain")
    return rounded(d.select("variable", "p_value"), "p_value", digits=5)


_CATS = ("technique", "comorbid", "cost_type")
_CAT_BASE = f"WITH {v.VISITS}, l AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c} AS level, pain FROM visits WHERE {c} IS NOT NULL" for c in _CATS) + """), k AS (
  SELECT variable, level, count(*) AS n, count(*) FILTER (pain = 0) AS n_0, count(*) FILTER (pain = 1) AS n_1 FROM l GROUP BY ALL), m AS (
  SELECT variable, sum(n) AS tn, sum(n_0) AS t0, sum(n_1) AS t1, count(*) AS levels FROM k GROUP BY 1), x AS (
  SELECT variable, sum(pow(n_0 - n * t0 / tn, 2) / (n * t0 / tn) + pow(n_1 - n * t1 / tn, 2) / (n * t1 / tn)) AS chi2
  FROM k JOIN m USING (variable) GROUP BY 1)"""


@query("baseline_categorical", f"""{_CAT_BASE} SELECT variable, level, n, {r('100e0 * n / tn')} AS proportion_pct, n_0, n_1,
  {r('chi2')} AS chi2, (levels - 1)::INT AS dof FROM k JOIN m USING (variable) JOIN x USING (variable)""")
def _(t):
    return rounded(tableone.categorical_table(v.visits(t), _CATS, "pain", p_value=False), "proportion_pct", "chi2")


# upper tail of chi-square for 1, 3 and 4 degrees of freedom by Simpson's rule on u = sqrt(x) over 0..sqrt(chi2)
_CHI_TAIL = """1 - sqrt(chi2) / 6000 * (SELECT sum(CASE WHEN g IN (0, 2000) THEN 1 WHEN g % 2 = 1 THEN 4 ELSE 2 END
  * 2 * pow(sqrt(chi2) * g / 2000e0, dof - 1) * exp(-pow(sqrt(chi2) * g / 2000e0, 2) / 2))
  FROM generate_series(0, 2000) s(g)) / (pow(2, dof / 2e0) * exp(lgamma(dof / 2e0)))"""


@query("categorical_p_values", f"""{_CAT_BASE}, d AS (SELECT variable, chi2, (levels - 1)::INT AS dof
  FROM m JOIN x USING (variable)) SELECT variable, {r(_CHI_TAIL, 5)} AS p_value FROM d""")
def _(t):
    d = tableone.categorical_table(v.visits(t), _CATS, "pain")
    return rounded(d.select("variable", "p_value").distinct(), "p_value", digits=5)


@query("distinct_values", f"WITH {v.VISITS} SELECT DISTINCT comorbid AS value FROM visits")
def _(t):
    return de.distinct_values(v.visits(t), "comorbid")


@query("class_balance", f"""WITH {v.SCORED} SELECT y AS value, count(*) AS count,
  {r('100e0 * count(*) / sum(count(*)) OVER ()')} AS percentage FROM scored GROUP BY 1""")
def _(t):
    return rounded(de.class_balance(v.scored(t), "y"), "percentage")


@query("sorted_head", f"WITH {v.VISITS} SELECT visit_id, cost FROM visits ORDER BY cost DESC, visit_id LIMIT 5")
def _(t):
    return de.head_sorted(v.visits(t).select("visit_id", "cost"), {"cost": False, "visit_id": True}, 5)
