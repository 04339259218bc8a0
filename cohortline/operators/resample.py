"""Folds, splits and class rebalancing. All draws come from md5, so every run and every engine agrees."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortline.functions.cleaning import quoted
from cohortline.operators.neighbors import nearest_neighbors
from cohortline.operators.ranks import hash_int, hash_text, hash_unit, hashed_rank

MAX_CLASSES = 1000


def stratified_folds(df: DataFrame, id_col: str, label: str, folds: int = 10, seed: int = 222,
                     name: str = "fold") -> DataFrame:
    """Adds a fold 0..folds-1; the sizes of a class differ by at most one between folds."""
    ranked = hashed_rank(df, id_col, seed, [label], "__rank")
    return ranked.withColumn(name, F.pmod(F.col("__rank"), F.lit(folds)).cast("int")).drop("__rank")


def holdout_split(df: DataFrame, id_col: str, label: str, shares: Mapping[str, float], seed: int = 222,
                  name: str = "split") -> DataFrame:
    """Adds a split name; every class is cut in the given proportions (they must sum to 1)."""
    if not shares or abs(sum(shares.values()) - 1.0) > 1e-9:
        raise ValueError("shares must sum to 1")
    sizes = _class_sizes(df, label)
    total = _per_class(label, {c: float(n) for c, n in sizes.items()})
    ranked = hashed_rank(df.filter(quoted(label).isNotNull()), id_col, seed, [label], "__rank")
    at, edge, out = F.col("__rank") / total, 0.0, None
    parts = list(shares.items())
    for split, share in parts[:-1]:
        edge += share
        out = F.when(at < edge, split) if out is None else out.when(at < edge, split)
    last = F.lit(parts[-1][0])
    return ranked.withColumn(name, last if out is None else out.otherwise(last)).drop("__rank")


def choose_split(df: DataFrame, id_col: str, label: str, data: str, shares: Mapping[str, float],
                 seed: int = 222) -> DataFrame:
    """Rows of one named split; an unknown name is an error."""
    if data not in shares:
        raise ValueError(f"unknown split {data!r}, expected one of {sorted(shares)}")
    return holdout_split(df, id_col, label, shares, seed).filter(F.col("split") == data).drop("split")


def _class_sizes(df: DataFrame, label: str) -> dict:
    rows = (df.filter(quoted(label).isNotNull()).groupBy(quoted(label).alias("c")).agg(F.count("*").alias("n"))
            .limit(MAX_CLASSES + 1).collect())
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    return {r["c"]: r["n"] for r in sorted(rows, key=lambda r: r["c"])}


def _per_class(label: str, values: Mapping) -> Column:
    out = None
    for c, v in values.items():
        out = F.when(quoted(label) == c, F.lit(v)) if out is None else out.when(quoted(label) == c, F.lit(v))
    return out


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``(class, n, weight)`` with weight = rows / (classes * class size)."""
    counts = df.filter(quoted(label).isNotNull()).groupBy(quoted(label).alias("class")).agg(F.count("*").alias("n"))
    total = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k"))).scalar()
    return counts.select("class", "n", (total["n"] / (total["k"] * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, name: str = "weight", sizes: Mapping | None = None
                      ) -> tuple[DataFrame, int]:
    """The rows with the balanced weight of their class (a handful of constants, so no join), and their number.
    ``sizes`` are the class sizes, where they are known already."""
    sizes = sizes or _class_sizes(df, label)
    n, k = sum(sizes.values()), len(sizes)
    return df.withColumn(name, _per_class(label, {c: n / (k * m) for c, m in sizes.items()})), n


def _draws(spark: SparkSession, sizes: Mapping, label: str, dtype, seed: int) -> DataFrame | None:
    """Draws ``(label, draw, pick)`` that lift every class to the largest one; ``pick`` is a rank in the class.

    The draws are a distributed range, so a deficit of billions is no large array anywhere.
    """
    most = max(sizes.values())
    gaps = {c: most - n for c, n in sizes.items() if most > n}
    if not gaps:
        return None
    start, bounds = 0, []
    for c, gap in gaps.items():
        bounds.append((c, start, start + gap))
        start += gap
    draws = spark.range(start)
    cls = offset = size = None
    for c, lo, hi in bounds:
        hit = F.col("id") < hi
        if cls is None:
            cls, offset, size = F.when(hit, F.lit(c)), F.when(hit, F.lit(lo)), F.when(hit, F.lit(sizes[c]))
        else:
            cls, offset, size = cls.when(hit, F.lit(c)), offset.when(hit, F.lit(lo)), size.when(hit, F.lit(sizes[c]))
    out = draws.select(cls.cast(dtype).alias(label), (F.col("id") - offset + 1).alias("draw"), size.alias("size"))
    return out.select(label, "draw", F.pmod(hash_int(F.col("draw"), F.col(label), seed), F.col("size")).alias("pick"))


def random_oversample(df: DataFrame, id_col: str, label: str, seed: int = 222, name: str = "draw",
                      sizes: Mapping | None = None) -> DataFrame:
    """All rows plus copies drawn with replacement until every class is as large as the largest.

    Column ``draw`` is 0 for an original row and the draw number for a copy.
    Ranks are unique and picks uniform, so the join has no hot key.
    """
    base = df.filter(quoted(label).isNotNull())
    sizes = sizes or _class_sizes(df, label)
    draws = _draws(df.sparkSession, sizes, label, df.schema[label].dataType, seed)
    originals = base.withColumn(name, F.lit(0).cast("bigint"))
    if draws is None:
        return originals
    # rows of the largest class are never copied, so they are not ranked either
    small = [c for c, n in sizes.items() if n < max(sizes.values())]
    ranked = hashed_rank(base.filter(quoted(label).isin(*small)), id_col, seed, [label], "pick")
    copies = ranked.join(draws, [label, "pick"]).drop("pick").withColumnRenamed("draw", name)
    return originals.unionByName(copies.select(*originals.columns))


def smote(df: DataFrame, id_col: str, label: str, features: Sequence[str], neighbors: int = 5, seed: int = 222,
          name: str = "draw", sizes: Mapping | None = None) -> DataFrame:
    """All rows plus synthetic ones up to the size of the largest class: ``(id, label, features, draw)``.

    A synthetic row lies at a uniform point between a drawn row and one of its
    nearest neighbors of the same class; its id is that of the drawn row.
    """
    base = df.filter(quoted(label).isNotNull()).select(
        quoted(id_col), quoted(label), *[quoted(c).cast("double").alias(c) for c in features])
    sizes = sizes or _class_sizes(df, label)
    draws = _draws(df.sparkSession, sizes, label, df.schema[label].dataType, seed)
    out = base.withColumn(name, F.lit(0).cast("bigint"))
    if draws is None:
        return out
    most = max(sizes.values())
    for c, n in sizes.items():
        if n == most:
            continue
        if n < 2:
            raise ValueError(f"class {c!r} has a single row and so no neighbors")
        k = min(neighbors, n - 1)
        members = base.filter(quoted(label) == c)
        near = nearest_neighbors(members, id_col, features, k)
        ranked = hashed_rank(members, id_col, seed, [], "pick")
        which = F.pmod(hash_int(F.col("draw"), F.col(label), seed, "neighbor"), F.lit(k)).cast("int") + 1
        drawn = (draws.filter(quoted(label) == c)
                 .select("draw", "pick", which.alias("rank"),
                         hash_unit(F.col("draw"), F.col(label), seed, "gap").alias("u"))
                 .join(ranked, "pick"))
        paired = drawn.join(near.select(F.col("id").alias(id_col), "rank", "neighbor_id"), [id_col, "rank"])
        other = members.select(F.col(id_col).alias("neighbor_id"), *[quoted(f).alias(f"o{i}")
                                                                   for i, f in enumerate(features)])
        made = paired.join(other, "neighbor_id").select(
            quoted(id_col), quoted(label),
            *[(quoted(f) + F.col("u") * (F.col(f"o{i}") - quoted(f))).alias(f) for i, f in enumerate(features)],
            F.col("draw").alias(name))
        out = out.unionByName(made)
    return out


def background_sample(df: DataFrame, id_col: str, n: int = 100, seed: int = 42) -> DataFrame:
    """``n`` rows in a seeded hash order; each task keeps only its own first ``n``."""
    return (df.withColumn("__h", hash_text(F.col(id_col), seed)).orderBy("__h", id_col).limit(n).drop("__h"))


# Mock clinical columns as (name, kind, low, high); integers exclude the upper end.
MOCK_COLUMNS = (
    ("Age_years", "int", 18, 65),
    ("Weight_kg", "double", 50, 120),
    ("BMI", "double", 18, 35),
    ("Comorbidities", "int", 0, 2),
    ("Preop_Heart_Rate_bpm", "int", 60, 100),
    ("Intraop_Mean_Heart_Rate_bpm", "int", 70, 110),
    ("Intraop_Mean_Pulse_Ox_Percent", "double", 90, 100),
    ("Surgical_Time_min", "int", 30, 300),
    ("Cost_of_Procedure_euros", "double", 5000, 20000),
    ("SBP", "int", 100, 140),
    ("DBP", "int", 60, 90),
)


def mock_data(rows: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Seeded uniform clinical columns for each id of ``rows`` (``spark.range(n)`` gives a free-standing table)."""
    out = [quoted(id_col)]
    for c, kind, lo, hi in MOCK_COLUMNS:
        x = F.lit(float(lo)) + hash_unit(F.col(id_col), seed, c) * F.lit(float(hi - lo))
        out.append((F.floor(x).cast("int") if kind == "int" else x).alias(c))
    return rows.select(*out)
