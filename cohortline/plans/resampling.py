"""Queries on folds, splits, rebalancing and samples."""

from __future__ import annotations

from cohortline.operators import neighbors as nb, resample as rs
from cohortline.plans import views as v
from cohortline.plans.catalog import query, r, rounded


def hash_sql(*parts: str) -> str:
    """The 60-bit hash integer in SQL."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15))::BIGINT"


def rank_sql(id_col: str, seed: int, keys: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"(row_number() OVER ({part}ORDER BY md5(concat_ws(':', {id_col}, '{seed}')), {id_col}) - 1)"


@query("stratified_folds", f"WITH {v.SCORED} SELECT id, y, ({rank_sql('id', 222, 'y')} % 10)::INT AS fold FROM scored")
def _(t):
    return rs.stratified_folds(v.scored(t).select("id", "y"), "id", "y")


@query("holdout_split", f"""WITH {v.SCORED}, k AS (SELECT id, y, {rank_sql('id', 222, 'y')} / count(*) OVER (PARTITION BY y)
  AS place FROM scored) SELECT id, y, CASE WHEN place < 0.6e0 THEN 'train' WHEN place < 0.6e0 + 0.2e0 THEN 'valid' ELSE 'test' END
  AS split FROM k""")
def _(t):
    return rs.holdout_split(v.scored(t).select("id", "y"), "id", "y", {"train": 0.6, "valid": 0.2, "test": 0.2})


@query("random_oversample", f"""WITH {v.SCORED}, k AS (SELECT id, y, {rank_sql('id', 222, 'y')} AS pick FROM scored), n AS (
  SELECT y, count(*) AS size, max(count(*)) OVER () AS most FROM scored GROUP BY y), d AS (
  SELECT y, size, unnest(generate_series(1, most - size)) AS draw FROM n WHERE most > size), p AS (
  SELECT y, draw, {hash_sql('draw', 'y', "'222'")} % size AS pick FROM d)
SELECT id, y, 0::BIGINT AS draw FROM scored UNION ALL SELECT k.id, k.y, draw FROM p JOIN k USING (y, pick)""")
def _(t):
    return rs.random_oversample(v.scored(t).select("id", "y"), "id", "y")


@query("class_weights", f"""WITH {v.SCORED} SELECT y AS class, count(*) AS n,
  {r('sum(count(*)) OVER () / (count(*) OVER () * count(*))')} AS weight FROM scored GROUP BY y""")
def _(t):
    return rounded(rs.class_weights(v.scored(t), "y"), "weight")


@query("weighted_rows", f"""WITH {v.SCORED} SELECT id, y, {r('count(*) OVER () / (2e0 * count(*) OVER (PARTITION BY y))')}
  AS weight FROM scored""")
def _(t):
    return rounded(rs.with_class_weight(v.scored(t).select("id", "y"), "y")[0], "weight")


_D2 = " + ".join(f"(a.{d} - b.{d}) * (a.{d} - b.{d})" for d in v.DIMS)
_NEAR = f"""near AS (SELECT a.vec_id AS id, b.vec_id AS neighbor_id, {_D2} AS d2,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D2}, b.vec_id) AS rank
  FROM {{0}} a JOIN {{0}} b ON a.vec_id <> b.vec_id QUALIFY rank <= 5)"""


@query("nearest_rows", f"WITH {v.ML}, {_NEAR.format('ml')} SELECT id, rank::INT AS rank, neighbor_id, {r('d2', 9)} AS d2 FROM near")
def _(t):
    # small leaves, so the search across leaves takes part
    return rounded(nb.nearest_neighbors(v.ml(t), "vec_id", v.DIMS, 5, leaf_rows=128), "d2", digits=9)


@query("synthetic_minority", f"""WITH {v.ML}, minority AS (SELECT * FROM ml WHERE y = 1), {_NEAR.format('minority')},
n AS (SELECT count(*) FILTER (y = 1) AS size, count(*) FILTER (y = 0) - count(*) FILTER (y = 1) AS gap FROM ml),
d AS (SELECT unnest(generate_series(1, gap)) AS draw, size FROM n WHERE gap > 0),
p AS (SELECT draw, {hash_sql('draw', "'1'", "'222'")} % size AS pick,
  {hash_sql('draw', "'1'", "'222'", "'neighbor'")} % 5 + 1 AS rank,
  {hash_sql('draw', "'1'", "'222'", "'gap'")}::DOUBLE / pow(2, 60) AS u FROM d),
k AS (SELECT *, {rank_sql('vec_id', 222)} AS pick FROM minority)
SELECT vec_id, y, {', '.join(r(d) + ' AS ' + d for d in v.DIMS)}, 0::BIGINT AS draw FROM ml
UNION ALL SELECT k.vec_id, 1, {', '.join(r(f'k.{d} + u * (o.{d} - k.{d})') for d in v.DIMS)}, draw
FROM p JOIN k USING (pick) JOIN near ON near.id = k.vec_id AND near.rank = p.rank JOIN minority o ON o.vec_id = neighbor_id""")
def _(t):
    return rounded(rs.smote(v.ml(t), "vec_id", "y", v.DIMS), *v.DIMS)


@query("background_sample", f"""WITH {v.SCORED} SELECT id, signal FROM scored
ORDER BY md5(concat_ws(':', id, '42')), id LIMIT 100""")
def _(t):
    return rs.background_sample(v.scored(t).select("id", "signal"), "id")


def _mock_sql() -> str:
    out = []
    for c, kind, lo, hi in rs.MOCK_COLUMNS:
        u = hash_sql("c_custkey", "'42'", f"'{c}'") + "::DOUBLE / pow(2, 60)"
        x = f"{lo}e0 + {u} * {hi - lo}e0"
        out.append(f"floor({x})::INT AS \"{c}\"" if kind == "int" else f"{r(x)} AS \"{c}\"")
    return ", ".join(out)


@query("mock_rows", f"SELECT c_custkey, {_mock_sql()} FROM customer")
def _(t):
    d = rs.mock_data(t.customer, "c_custkey")
    return rounded(d, *[c for c, kind, _, _ in rs.MOCK_COLUMNS if kind == "double"])
