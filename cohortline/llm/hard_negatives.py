"""Hard negatives by exact inner products, several candidates in one number (Kronecker packing).

Components are made whole numbers (``floor(256 x)``). To score an anchor against
many candidates, the components of both are shifted to start from zero, and those
of several candidates are put into separate fields of one wide integer: every
field is as wide as the largest sum can get, so fields never carry into each
other. One multiplication per component of the anchor then adds to all fields at
once; unpacked and with the shifts taken out again, each is the exact score. Up to
53 bits the wide integers lie in double precision, which holds them exactly; values
that need more go, by themselves, through Python's unbounded integers.

Rows are dealt by a hash of their id to groups of bounded size. Each group is held
in one task while all anchors, repeated per group and sorted behind it, stream by in
batches: memory depends on neither number. A pass finds each anchor's best rows of
its label, a second one, for each of these, the best rows of other labels inside
its range; what groups found is merged by key, at most five rows a group. All rows
are scored against all anchors; nothing is estimated, capped or sampled.

Rows with a null id, label or vector, or with a null or non-finite component take no
part. Missing components of a shorter vector count as zero, so an empty vector scores
zero. Rows that share an id count once: the smallest label, then the smallest vector.
Ties in score go to the smaller id. Anchors without a row of their label, positives
without a row in range and an empty table give no rows. Other columns are not read.
A score beyond 64 bits raises ``OverflowError``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortline.session import bucket_count, materialize

SCALE, POSITIVES, NEGATIVES, LEAST_SHARE = 256, 5, 5, (80, 100)
GROUP_BYTES, GROUP_ROWS, ANCHOR_SLICE, CHUNK = 32 << 20, 2048, 128, 8192
EXACT_BITS = 53
_LOWEST = np.iinfo(np.int64).min


def whole_components(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component, as doubles that are whole numbers."""
    def whole(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(scale))
        # from 2^52 on, doubles are whole
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    """Whether there is a vector and all its components are finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``x``, whole numbers held as doubles, exactly."""
    n, dims = x.shape
    if not n or not len(a) or not dims:
        return np.zeros((len(a), n), np.int64)
    low_a, low_x = int(a.min()), int(x.min())
    high_a, high_x = int(a.max()), int(x.max())
    bits = max(1, (dims * (high_a - low_a) * (high_x - low_x)).bit_length())
    if bits <= EXACT_BITS and dims * max(-low_a, high_a, 1) * max(-low_x, high_x, 1) < 1 << 61:
        fields = EXACT_BITS // bits
        width = -(-n // fields)
        u, v = x - low_x, a - low_a
        packed = np.zeros((width, dims))
        for k in range(fields):
            own = u[k * width:(k + 1) * width]
            packed[:len(own)] += own * float(1 << k * bits)
        wide = (v @ packed.T).astype(np.int64)
        parts = [(wide >> k * bits) & ((1 << bits) - 1) for k in range(fields)]
        score = np.concatenate(parts, axis=1)[:, :n]
        score += (low_x * v.sum(1)).astype(np.int64)[:, None] + (low_a * u.sum(1)).astype(np.int64)[None, :] + dims * low_a * low_x
        return score
    fields = 8
    width = -(-n // fields)
    whole = lambda m, low: np.array([[int(c) - low for c in r] for r in m.tolist()], object).reshape(m.shape)
    u, v = whole(x, low_x), whole(a, low_a)
    packed = np.zeros((width, dims), object)
    for k in range(fields):
        own = u[k * width:(k + 1) * width]
        packed[:len(own)] += own << k * bits
    wide = v.dot(packed.T)
    score = np.concatenate([(wide >> k * bits) & ((1 << bits) - 1) for k in range(fields)], axis=1)[:, :n]
    score = score + (low_x * v.sum(1))[:, None] + (low_a * u.sum(1))[None, :] + dims * low_a * low_x
    if max(abs(score.min()), abs(score.max())) >= 1 << 62:
        raise OverflowError("a score passes 64 bits")
    return score.astype(np.int64)


def parted(m: np.ndarray) -> list[np.ndarray]:
    """Row numbers of those with small components, of which several share a number, and of all others."""
    if not m.size:
        return [np.arange(len(m))]
    limit = 2.0 ** ((EXACT_BITS // 2 - m.shape[1].bit_length()) // 2 - 1)
    small = np.abs(m).max(1) <= limit
    return [rows for rows in (np.flatnonzero(small), np.flatnonzero(~small)) if len(rows)]


def all_products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(x)), np.int64)
    for r in parted(a):
        for c in parted(x):
            out[np.ix_(r, c)] = products(a[r], x[c])
    return out


def matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Vectors of a list column as rows, cut or filled with zeros to ``dims`` (the longest)."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(lists.value_lengths(), np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    longest = int(lengths.max(initial=0))
    if len(lengths) and (lengths == longest).all():
        out = values.reshape(len(lengths), longest)
    else:
        out = np.zeros((len(lengths), longest))
        out[np.arange(longest) < lengths[:, None]] = values
    if dims is None or dims == longest:
        return out
    return np.pad(out, ((0, 0), (0, max(0, dims - longest))))[:, :dims]


class Best:
    """The first ``k`` of each row, by score descending and then id."""

    def __init__(self, rows: int, k: int):
        self.rows, self.k = rows, k
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(rows, _LOWEST)  # the k-th score so far

    def add(self, scores: np.ndarray, able: np.ndarray, ids: np.ndarray) -> None:
        """Take from a chunk; ``ids`` ascend within a chunk and from one to the next."""
        able = able & (scores > self.least[:, None])
        many = np.count_nonzero(able, axis=1) > 4 * self.k
        if many.any() and len(ids) > self.k:
            # more than a few: the k-th score is a bound that all but k and ties stay below
            own = np.where(able[many], scores[many], _LOWEST)
            bound = np.partition(own, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            over = own > bound[:, None]
            tied = own == bound[:, None]
            room = self.k - np.count_nonzero(over, axis=1)
            able[many] = over | (tied & (np.cumsum(tied, axis=1) <= room[:, None]))
        row, col = np.nonzero(able)
        if not len(row):
            return
        row, score, id_ = np.append(self.row, row), np.append(self.score, scores[row, col]), np.append(self.id, ids[col])
        order = np.lexsort((id_, -score, row))
        row, score, id_ = row[order], score[order], id_[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.row, self.score, self.id = row[keep], score[keep], id_[keep]
        last = rank[keep] == self.k - 1
        self.least[self.row[last]] = self.score[last]


class Group:
    """Candidates of one group, by id."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches)
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], table.column("label").to_numpy()[order]
        self.vectors = matrix(table.column("vector"))[order]

    def positives(self, anchors: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
        ids, labels = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
        vectors = matrix(anchors.column("vector"), self.vectors.shape[1])
        found = []
        for label in np.unique(labels):
            mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(self.labels == label)
            best = Best(len(mine), k)
            for at in range(0, len(theirs), CHUNK):
                cols = theirs[at:at + CHUNK]
                best.add(all_products(vectors[mine], self.vectors[cols]), ids[mine][:, None] != self.ids[cols], self.ids[cols])
            found.append((ids[mine][best.row], best.id, best.score))
        return tuple(np.concatenate(c) for c in zip(*found))

    def negatives(self, anchors: pa.RecordBatch, k: int, share: tuple[int, int]) -> tuple[np.ndarray, ...]:
        ids, labels = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
        vectors = matrix(anchors.column("vector"), self.vectors.shape[1])
        wanted = np.asarray(anchors.column("positive_ids").value_lengths(), np.int64)
        anchor = np.repeat(np.arange(len(ids)), wanted)
        positive = anchors.column("positive_ids").flatten().to_numpy()
        high = anchors.column("positive_scores").flatten().to_numpy()
        low = np.array([-(-share[0] * int(s) // share[1]) for s in high], np.int64)
        best = Best(len(anchor), k)
        for at in range(0, len(self.ids), CHUNK):
            scores = all_products(vectors, self.vectors[at:at + CHUNK])
            other = labels[:, None] != self.labels[at:at + CHUNK]
            own = scores[anchor]
            best.add(own, other[anchor] & (own <= high[:, None]) & (own >= low[:, None]), self.ids[at:at + CHUNK])
        return ids[anchor][best.row], positive[best.row], high[best.row], best.id, best.score


def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Slices of a sorted batch with equal group and side."""
    group, side = batch.column("group").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
    cuts = np.flatnonzero((group[1:] != group[:-1]) | (side[1:] != side[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield int(group[a]), bool(side[a]), batch.slice(a, b - a)


def streamed(held: DataFrame, queries: DataFrame, groups: int, find: Callable, arrow: pa.Schema, schema: str) -> DataFrame:
    """``find(group, slice of queries)`` for every group of ``held`` and all queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, group = None, [], None
        for batch in batches:
            for number, is_query, rows in runs(batch):
                if number != at:
                    at, parts, group = number, [], None
                if not is_query:
                    parts.append(rows)
                    continue
                if group is None and parts:
                    group, parts = Group(parts), []
                if group is None:
                    continue
                for k in range(0, rows.num_rows, ANCHOR_SLICE):
                    found = find(group, rows.slice(k, ANCHOR_SLICE))
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], schema=arrow)

    rows = held.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), F.lit(False).alias("is_query"), "*")
    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(True).alias("is_query"), "*")
    dealt = rows.unionByName(sent, allowMissingColumns=True).repartition(groups, "group")
    return dealt.sortWithinPartitions("group", "is_query").mapInArrow(run, schema)


def firsts(found: DataFrame, keys: list[str], k: int, id_: str, score: str) -> DataFrame:
    """Of each key, the first ``k`` by score descending and then id, as ``firsts``: an array of ``low`` (minus the score) and ``id``."""
    rows = F.collect_list(F.struct((-F.col(score)).alias("low"), F.col(id_).alias("id")))
    return found.groupBy(*keys).agg(F.slice(F.sort_array(rows), 1, k).alias("firsts"))


def hard_negatives(rows: DataFrame, is_anchor: Column, id_column: str = "vec_id", vector_column: str = "embedding",
                   label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
                   least_share: tuple[int, int] = LEAST_SHARE, scale: int = SCALE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that ``is_anchor`` names.

    An anchor's positives are its first ``positives`` other rows of its label; of each, ``rank`` counts the first
    ``negatives`` rows of other labels that score between ``least_share`` (a fraction) of the positive's score and that score.
    """
    spark = rows.sparkSession
    vector = F.col(f"`{vector_column}`")
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    able = rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("vector"),
                       is_anchor.alias("is_anchor")).where("id is not null and label is not null").where(usable(F.col("vector")))
    whole = able.select("id", "is_anchor", F.struct("label", whole_components(F.col("vector"), scale).alias("vector")).alias("row"))
    items = materialize(whole.groupBy("id").agg(F.min("row").alias("row"), F.max("is_anchor").alias("is_anchor"))
                        .select("id", "row.label", "row.vector", "is_anchor"), "vectors")
    n, components = items.agg(F.count("*"), F.sum(F.size("vector"))).first()
    groups = max(1, -(-8 * (components or 0) // group_bytes), min(bucket_count(spark, 1), -(-n // GROUP_ROWS)))
    held, anchors = items.drop("is_anchor"), items.where("is_anchor").drop("is_anchor")

    long = pa.int64()
    pairs = streamed(held, anchors, groups, lambda g, a: g.positives(a, positives),
                     pa.schema([("anchor_id", long), ("positive_id", long), ("positive_score", long)]),
                     "anchor_id long, positive_id long, positive_score long")
    wanted = firsts(pairs, ["anchor_id"], positives, "positive_id", "positive_score")
    queries = materialize(anchors.join(wanted, F.col("id") == F.col("anchor_id")).select(
        "id", "label", "vector", F.col("firsts.id").alias("positive_ids"),
        F.transform("firsts.low", lambda s: -s).alias("positive_scores")), "anchors")

    triples = streamed(held, queries, groups, lambda g, a: g.negatives(a, negatives, least_share),
                       pa.schema([(c, long) for c in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")]),
                       "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    found = firsts(triples, ["anchor_id", "positive_id", "positive_score"], negatives, "negative_id", "negative_score")
    return found.select("anchor_id", "positive_id", "positive_score", F.posexplode("firsts").alias("at", "found")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("found.id").alias("negative_id"), "positive_score",
        (-F.col("found.low")).alias("negative_score"))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
WHERE rank <= 5
"""
