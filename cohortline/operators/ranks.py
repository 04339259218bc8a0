"""Ordered work without a global sort in one task.

Running totals and row ranks over a whole table have no partition key that keeps a
task small. They follow one pattern: cut the order into buckets, total the buckets (a
map-side combined aggregate with a few rows per key), prefix-sum those totals, and do
the fine ordering inside a bucket. No step sees more than one bucket of one key at a
time. Exact quantiles order only what a quantile summary brackets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortline.session import bucket_count, materialize

INF = float("inf")
SAMPLE_PER_BUCKET = 200
MANY_PARTITIONS = 1000
ACCURACY = 4000


def order_splits(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> dict[str, list[float]]:
    """Cut points that give each column about equally filled buckets.

    Taken from a sample of bounded size, so what reaches the one merging task does
    not grow with the table. The points only balance the work; results never
    depend on them.
    """
    n = buckets or bucket_count(df.sparkSession)
    probs = [i / n for i in range(1, n)]
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    fraction = SAMPLE_PER_BUCKET * n / max(1, df.count())
    if fraction < 1.0:
        rows = rows.sample(fraction, seed=7)
    row = rows.agg(*[F.percentile_approx(f"c{i}", probs, 10 * n).alias(f"c{i}") for i in range(len(columns))]).first()
    out = {}
    for i, c in enumerate(columns):
        points = sorted({v for v in (row[f"c{i}"] or []) if v == v and abs(v) != INF})
        out[c] = [-INF, *points, INF] if points else [-INF, 0.0, INF]
    return out


def with_buckets(df: DataFrame, splits: dict[str, list[float]], suffix: str = "__bucket") -> DataFrame:
    """Add ``{column}{suffix}``, the index of the bucket each value falls into."""
    names = df.columns
    for c, points in splits.items():
        df = Bucketizer(splits=points, inputCol=c, outputCol=c + suffix, handleInvalid="keep").transform(df)
    return df.selectExpr(*[sql_name(c) for c in names],
                         *[f"cast({sql_name(c + suffix)} as int) as {sql_name(c + suffix)}" for c in splits])


def sql_name(name: str) -> str:
    """Column name as it is written in a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    """String literal as it is written in a SQL expression."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str,
            extra: dict[str, Sequence[str]] | None = None, cast: str | None = None) -> DataFrame:
    """Wide to long: one row per (row, column). ``extra`` carries parallel columns along."""
    structs = []
    for i, c in enumerate(columns):
        cell = f"cast({sql_name(c)} as {cast})" if cast else sql_name(c)
        parts = [f"{sql_text(c)} as {sql_name(name)}", f"{cell} as {sql_name(value)}"]
        parts += [f"{sql_name(cols[i])} as {sql_name(alias)}" for alias, cols in (extra or {}).items()]
        structs.append(f"struct({', '.join(parts)})")
    return df.selectExpr(*[sql_name(k) for k in keys], f"inline(array({', '.join(structs)}))")


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    keys: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """Exact, linearly interpolated quantiles per key and column.

    Returns ``(*keys, variable, n, q0, q1, ...)``. Two jobs, for any number of columns: a mergeable quantile summary
    of all of them, whose ranks are off by at most ``n / accuracy``, brackets every wanted rank; then one more pass
    counts what lies below each bracket and orders only the values inside (a few of ``accuracy`` parts of the rows).
    No key is gathered into one task. The brackets are written out, so their true size decides how they meet the
    rows. A rank outside its bracket would be an error, never a wrong value. Rows with a missing key or value are
    left out.
    """
    keys, columns = list(keys), list(columns)
    edges = [min(1.0, max(0.0, p + side * 2.0 / accuracy)) for p in probs for side in (-1, 1)]
    value = [F.col(f"`{c}`").cast("double") for c in columns]
    rows = df.select(*[F.col(f"`{k}`") for k in keys], *[F.when(~F.isnan(x), x).alias(f"__v{i}") for i, x in enumerate(value)])
    for k in keys:
        rows = rows.filter(F.col(f"`{k}`").isNotNull())
    every = range(len(columns))
    group = [F.col(f"`{k}`") for k in keys]
    found = rows.groupBy(*group).agg(
        *[F.percentile_approx(f"__v{i}", edges, accuracy).alias(f"__q{i}") for i in every],
        *[F.count(f"__v{i}").alias(f"__n{i}") for i in every])
    if keys:
        rows = rows.join(materialize(found, "brackets"), keys)
    else:
        only = found.first()
        rows = rows.select("*", *[F.array(*[F.lit(v).cast("double") for v in only[f"__q{i}"] or [None] * len(edges)]).alias(f"__q{i}")
                                  for i in every], *[F.lit(only[f"__n{i}"]).alias(f"__n{i}") for i in every])

    def bracket(i: int, j: int) -> tuple[Column, Column]:
        return F.get(F.col(f"__q{i}"), F.lit(2 * j)), F.get(F.col(f"__q{i}"), F.lit(2 * j + 1))

    asked = [(i, j) for i in every for j in range(len(probs))]
    sums = [F.max(f"__n{i}").alias(f"n{i}") for i in every]
    for i, j in asked:
        x, (low, high) = F.col(f"__v{i}"), bracket(i, j)
        sums += [F.count_if(x < low).alias(f"b{i}_{j}"), F.max(F.when(x < low, x)).alias(f"p{i}_{j}"),
                 F.min(F.when(x > high, x)).alias(f"s{i}_{j}")]
    around = rows.groupBy(*group).agg(*sums).select(*group, F.inline(F.array(*[F.struct(
        F.lit(i).alias("__c"), F.lit(j).alias("__p"), F.col(f"n{i}").alias("n"), F.col(f"b{i}_{j}").alias("below"),
        F.col(f"p{i}_{j}").alias("previous"), F.col(f"s{i}_{j}").alias("following")) for i, j in asked]))).filter("n > 0")
    cells = F.array(*[F.when(F.col(f"__v{i}").between(*bracket(i, j)), F.struct(
        F.lit(i).alias("__c"), F.lit(j).alias("__p"), F.col(f"__v{i}").alias("value"))) for i, j in asked])
    inside = (rows.select(*group, F.inline(F.filter(cells, lambda c: c.isNotNull())))
              .groupBy(*group, "__c", "__p", "value").agg(F.count("*").alias("c")))
    names = [*keys, "__c", "__p"]
    run = W.partitionBy(*[F.col(f"`{k}`") for k in names]).orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    placed = (inside.join(around, names).withColumn("end", F.col("below") + F.sum("c").over(run))
              .withColumn("start", F.col("end") - F.col("c")))
    chance = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("__p") + 1)
    target = (F.col("n") - 1) * chance

    def at(rank: Column) -> Column:
        here = F.max(F.when((rank >= F.col("start")) & (rank < F.col("end")), F.col("value")))
        return F.coalesce(here, F.max(F.when(rank == F.col("below") - 1, F.col("previous"))),
                          F.max(F.when(rank == F.col("last"), F.col("following"))),
                          F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))

    whole = W.partitionBy(*[F.col(f"`{k}`") for k in names])
    low, high = at(F.floor(target)), at(F.ceil(target))
    picked = placed.withColumn("last", F.max("end").over(whole)).groupBy(*group, "__c", "__p").agg(
        F.first("n").alias("n"), low.alias("low"), high.alias("high"), F.first(target - F.floor(target)).alias("share"))
    picked = picked.withColumn("q", F.col("low") + (F.col("high") - F.col("low")) * F.col("share"))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("__c") + 1)
    return picked.groupBy(*group, "__c").agg(F.first("n").alias("n"), *[
        F.max(F.when(F.col("__p") == j, F.col("q"))).alias(f"q{j}") for j in range(len(probs))]).select(
        *group, name.alias("variable"), "n", *[f"q{j}" for j in range(len(probs))])


def running_totals(points: DataFrame, totals: DataFrame, keys: Sequence[str], bucket: str, order: str,
                   measures: Sequence[str], descending: bool = True) -> DataFrame:
    """Inclusive running sums ``{m}_run`` and key totals ``{m}_all`` along ``order`` within ``keys``.

    ``points`` holds one row per (keys, bucket, order) and ``totals`` the sums per
    (keys, bucket), both with the measures. The join and the window share one partitioning.
    """
    keys = list(keys)
    direction = F.desc if descending else F.asc
    per_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    prefix = per_key.orderBy(direction(bucket)).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, bucket,
        *[F.coalesce(F.sum(m).over(prefix), F.lit(0)).alias(f"{m}_off") for m in measures],
        *[F.sum(m).over(per_key).alias(f"{m}_all") for m in measures],
    )
    inner = W.partitionBy(*keys, bucket).orderBy(direction(order)).rowsBetween(W.unboundedPreceding, 0)
    out = points.join(offsets, [*keys, bucket])
    for m in measures:
        out = out.withColumn(f"{m}_run", F.col(f"{m}_off") + F.sum(m).over(inner))
    return out.drop(*[f"{m}_off" for m in measures])


def hash_text(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by ``:`` — the same text in every engine, so an order can be replayed."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]).cast("binary"))


def hash_int(*parts: Column | str | int) -> Column:
    """Uniform non-negative 60-bit integer derived from :func:`hash_text`."""
    return F.conv(F.substring(hash_text(*parts), 1, 15), 16, 10).cast("bigint")


def hash_unit(*parts: Column | str | int) -> Column:
    """Uniform double in [0, 1) derived from :func:`hash_int`."""
    return hash_int(*parts).cast("double") / F.lit(float(1 << 60))


def hashed_rank(df: DataFrame, id_col: str, seed: int | str, keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Dense 0-based rank of each row within ``keys``, in a seeded pseudo-random order.

    The order is the md5 of id and seed. Its first hex characters cut it into
    even buckets, whatever the ids look like, so a class that holds most rows is
    spread over all of them. Key and bucket form one struct, which compares missing
    keys as equal and lets join and window share one shuffle.
    """
    keys = list(keys)
    many = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) > MANY_PARTITIONS
    text = hash_text(F.col(f"`{id_col}`"), seed)
    part = F.struct(*[F.col(f"`{k}`") for k in keys], F.substring(text, 1, 4 if many else 3).alias("__b"))
    tagged = df.withColumn("__p", part)
    group = F.struct(*[F.col("__p").getField(k) for k in keys]) if keys else F.lit(0)
    before = W.partitionBy(group).orderBy(F.col("__p").getField("__b")).rowsBetween(W.unboundedPreceding, -1)
    offsets = tagged.groupBy("__p").agg(F.count("*").alias("__cnt")).select(
        "__p", F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__off"))
    inner = W.partitionBy("__p").orderBy("__h", id_col)
    # the full hash is computed again behind the shuffle, which is cheaper than sending it
    placed = tagged.repartition("__p").join(offsets, "__p").withColumn("__h", text)
    return (placed.withColumn(name, F.col("__off") + F.row_number().over(inner) - 1)
            .select(*[F.col(f"`{c}`") for c in df.columns], name))
