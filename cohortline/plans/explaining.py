"""Queries on joins of features, labels and explanations, and on attributions."""

from __future__ import annotations

from math import factorial

from pyspark.sql import functions as F

from cohortline.operators import columns as co, explain as ex, models as mo
from cohortline.operators.resample import background_sample
from cohortline.operators.scores import LinearScore
from cohortline.plans import modeling, views as v
from cohortline.plans.catalog import query, r, rounded

WEIGHTS = dict(zip(v.DIMS, (3.0, -2.0, 1.5, 0.5, -1.0, 2.5, -0.5, 1.0, 0.25, -1.5, 2.0, -3.0, 0.75)))
SCORE = LinearScore(list(WEIGHTS.values()), -0.5)
SOME = v.DIMS[:4]  # for a score that needs a DataFrame, whose rows are copied per coalition


@query("features_with_labels", f"WITH {v.ML} SELECT * FROM ml")
def _(t):
    x, y = co.split_features_label(v.ml(t), "vec_id", "y")
    return x.join(y, "vec_id")


@query("documents_with_labels", """SELECT d.doc_id, lang, n_chars, quality, toxic FROM documents d JOIN labels l
ON d.doc_id = l.doc_id""")
def _(t):
    return t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")


@query("explanations_with_features", f"""WITH {v.ML}, {v.SCORED} SELECT vec_id, ml.d0, ml.y, signal AS y_pred_proba
FROM ml JOIN scored ON vec_id = scored.id""")
def _(t):
    x, y = co.split_features_label(v.ml(t), "vec_id", "y")
    explained = v.scored(t).select(F.col("id").cast("string").cast("bigint").alias("vec_id"),
                                   F.col("signal").alias("y_pred_proba"))
    return x.select("vec_id", "d0").join(y, "vec_id").join(explained, "vec_id")


@query("ids_by_natural_key", """WITH ranked AS (SELECT o_orderkey, o_totalprice,
  row_number() OVER (ORDER BY md5(concat(o_orderkey, ':222')), o_orderkey) - 1 AS k FROM orders), ids AS (
  SELECT o_orderkey, 100000000 + ((k::HUGEINT * 40353607 + 222) % 900000000)::BIGINT AS patient_id FROM ranked)
SELECT patient_id, orders.o_orderkey, o_custkey FROM ids JOIN orders USING (o_orderkey)""")
def _(t):
    ids = co.add_ids(t.orders.select("o_orderkey"), "o_orderkey")
    return ids.join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").select(
        "patient_id", "o_orderkey", "o_custkey")


@query("column_difference", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def _(t):
    return t.orders.select(*co.difference(t.orders.columns, ["o_orderstatus", "o_custkey", "o_orderpriority"]))


_ABS = ", ".join(f"{{'name': '{d}', 'pos': {i}, 'v': round_even(abs({d}) * 1e2, 0) / 1e2}}" for i, d in enumerate(v.DIMS))
_TOP = f"""WITH {v.ML}, l AS (SELECT vec_id, unnest([{_ABS}]) AS s FROM ml), k AS (
  SELECT vec_id, s.name AS name, s.v AS v, row_number() OVER (PARTITION BY vec_id ORDER BY s.v DESC, s.pos) AS rank FROM l
  QUALIFY rank <= 3)"""


@query("top_feature_names", f"{_TOP} SELECT vec_id, string_agg(name, ', ' ORDER BY rank) AS names FROM k GROUP BY 1")
def _(t):
    return v.ml(t).select("vec_id", ex.top_names(v.DIMS, 3).alias("names"))


@query("top_features", f"{_TOP} SELECT vec_id, name, rank::INT AS rank, v FROM k")
def _(t):
    d = v.ml(t).select("vec_id", F.posexplode(ex.top_features(v.DIMS, 3)).alias("i", "s"))
    return d.select("vec_id", F.col("s.name").alias("name"), (F.col("i") + 1).alias("rank"), F.col("s.value").alias("v"))


@query("top_features_json", f"""{_TOP} SELECT vec_id,
  concat('{{', string_agg(concat('"', name, '":', v::VARCHAR), ',' ORDER BY rank), '}}') AS features FROM k GROUP BY 1""")
def _(t):
    return v.ml(t).select("vec_id", ex.top_json(v.DIMS, 3).alias("features"))


def linear_score(d, features):
    z = F.lit(-0.5)
    for c in features:
        z += F.lit(WEIGHTS[c]) * F.col(c)
    return d.withColumn("p", 1.0 / (1.0 + F.exp(-z)))


_POSITION = "list_position([" + ", ".join(f"'{c}'" for c in v.DIMS) + "], feature)"


def _attribution_sql(features) -> str:
    """All coalitions of some features: the row's and the background's share of the margin add up per coalition."""
    p, fact = len(features), [factorial(k) for k in range(len(features) + 1)]
    inside = " + ".join(f"{WEIGHTS[c]}e0 * {c} * ((m >> {j}) & 1)" for j, c in enumerate(features))
    outside = " + ".join(f"{WEIGHTS[c]}e0 * {c} * (1 - ((m >> {j}) & 1))" for j, c in enumerate(features))
    win = ", ".join(f"{fact[s - 1] * fact[p - s]}e0 / {fact[p]}" for s in range(1, p + 1))
    lose = ", ".join(f"-{fact[s] * fact[p - s - 1]}e0 / {fact[p]}" for s in range(p))
    phis = ", ".join(f"sum(v * CASE WHEN (m >> {j}) & 1 = 1 THEN [{win}][bit_count(m)] ELSE [{lose}][bit_count(m) + 1] END) AS {c}"
                     for j, c in enumerate(features))
    long = " UNION ALL ".join(f"SELECT vec_id, '{c}' AS feature, {c} AS phi FROM wide" for c in features)
    return f"""WITH {v.ML}, g AS (SELECT m::INT AS m FROM generate_series(0, {(1 << p) - 1}) s(m)),
b AS (SELECT * FROM ml ORDER BY md5(concat_ws(':', vec_id, '42')), vec_id LIMIT 100),
x AS (SELECT vec_id, m, {inside} AS z FROM ml CROSS JOIN g), o AS (SELECT m, {outside} - 0.5e0 AS z FROM b CROSS JOIN g),
val AS (SELECT x.vec_id, m, avg(1 / (1 + exp(-(x.z + o.z)))) AS v FROM x JOIN o USING (m) GROUP BY ALL),
wide AS (SELECT vec_id, {phis} FROM val GROUP BY 1), phi AS ({long})"""


_PHI = _attribution_sql(v.DIMS)


def _phi(t):
    d = v.ml(t)
    return ex.shapley(d, "vec_id", v.DIMS, background_sample(d, "vec_id", 100), SCORE)


@query("attributions", f"{_PHI} SELECT vec_id, feature, {r('phi')} AS phi FROM phi")
def _(t):
    return rounded(_phi(t), "phi")


@query("attributions_of_expression", f"{_attribution_sql(SOME)} SELECT vec_id, feature, {r('phi')} AS phi FROM phi")
def _(t):
    d = v.ml(t)
    background = background_sample(d, "vec_id", 100)
    return rounded(ex.kernel_shap(d, "vec_id", SOME, background, lambda x: linear_score(x, SOME)), "phi")


@query("attributions_wide", f"{_PHI} SELECT vec_id, {', '.join(f'{r(c)} AS {c}' for c in v.DIMS)} FROM wide")
def _(t):
    return rounded(ex.attribution_wide(_phi(t), "vec_id", v.DIMS), *v.DIMS)


@query("global_importance", f"{_PHI} SELECT feature, {r('avg(abs(phi))')} AS importance FROM phi GROUP BY 1")
def _(t):
    return rounded(ex.global_importance(_phi(t)), "importance")


@query("attributions_with_values", f"{_PHI} SELECT vec_id, feature, {r('phi')} AS phi, CASE feature " + " ".join(
    f"WHEN '{c}' THEN {c}" for c in v.DIMS) + " END AS value FROM phi JOIN ml USING (vec_id)")
def _(t):
    return rounded(ex.attribution_values(_phi(t), v.ml(t), "vec_id", v.DIMS), "phi")


_MEANS = ", ".join(f"avg({c}) OVER () AS m_{c}" for c in v.DIMS)


@query("linear_attributions", f"WITH {v.ML}, m AS (SELECT *, {_MEANS} FROM ml) " + " UNION ALL ".join(
    f"SELECT vec_id, '{c}' AS feature, {r(f'{w}e0 * ({c} - m_{c})')} AS phi FROM m" for c, w in WEIGHTS.items()))
def _(t):
    d = v.ml(t)
    means = d.agg(*[F.avg(c).alias(c) for c in v.DIMS]).first().asDict()
    return rounded(ex.linear_attribution(d, "vec_id", WEIGHTS, means), "phi")


_Z = " + ".join(f"{w}e0 * {c}" for c, w in WEIGHTS.items())


@query("explanation_table", f"""{_PHI}, k AS (SELECT vec_id, feature, row_number() OVER (PARTITION BY vec_id
  ORDER BY round_even(abs(phi) * 1e2, 0) DESC, {_POSITION}) AS rank FROM phi QUALIFY rank <= 2), n AS (
  SELECT vec_id, string_agg(feature, ', ' ORDER BY rank) AS names FROM k GROUP BY 1), s AS (
  SELECT vec_id, y, 1 / (1 + exp(-(-0.5e0 + {_Z}))) AS p FROM ml)
SELECT vec_id, names AS "Top 2 Features", {r('p')} AS y_pred_proba, (p > 0.4e0)::INT AS y_pred,
  (y = 1 AND p > 0.4e0)::INT AS "TP", (y = 1 AND p <= 0.4e0)::INT AS "FN",
  (y = 0 AND p > 0.4e0)::INT AS "FP", (y = 0 AND p <= 0.4e0)::INT AS "TN" FROM n JOIN s USING (vec_id)""")
def _(t):
    wide = ex.attribution_wide(_phi(t), "vec_id", v.DIMS)
    d = ex.explanation_table(wide, linear_score(v.ml(t), v.DIMS), "vec_id", v.DIMS, 2, "p", "y", 0.4, with_values=False)
    return rounded(d, "y_pred_proba")


@query("explained_model")
def _(t):
    d = v.ml(t)
    model = mo.fit(d, "vec_id", "y", v.DIMS, mo.Spec("lr", {"C": 1.0}))
    return rounded(modeling.explain_rows(d, "vec_id", model, 3, 100, "y"), "y_pred_proba")


@query("forest_attributions")
def _(t):
    """Every row against 100 background rows, by the paths of the forest's trees."""
    d = v.ml(t)
    model = mo.fit(d, "vec_id", "y", v.DIMS, mo.Spec("rf", {"n_estimators": 10, "max_depth": 10, "min_samples_split": 2}))
    return rounded(ex.shapley(d, "vec_id", v.DIMS, background_sample(d, "vec_id", 100), model.array_score()), "phi")


@query("explained_forest")
def _(t):
    """The explanation table of a calibrated forest."""
    d = v.ml(t)
    model, _, _ = mo.tune(d, "vec_id", "y", v.DIMS, [mo.Spec("rf", {"n_estimators": 10, "max_depth": 5})], folds=10)
    return rounded(modeling.explain_rows(d, "vec_id", model, 3, 100, "y", with_values=False), "y_pred_proba")
