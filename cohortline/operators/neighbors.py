"""Exact k nearest neighbors within one table, without comparing all pairs one by one.

Points are cut into leaves by median splits. A first tree is learned on a bounded
sample; leaves that turn out too large are split again by trees that are learned
per leaf, on samples of their own, until all are bounded, however many points there
are. What the driver holds is the tree, a box per leaf and a box per cell.

Leaves next to each other make a group, as many as keep all tasks busy. A group's points
lie in small cells with boxes of their own, and are searched there first. A cell of another
group is sent to it, whole and once, if it lies within the k-th distance that some cell of
the group has found so far, and is looked into by those points only that it is within
reach of. Products of matrices choose, with a bound on their rounding, which points of
a cell are worth an exact distance. Cells and groups have bounded sizes, so no task holds
much, and nothing is cut off: the lists are exact, ties going to the smaller id.

Copies of a vector would make a leaf unsplittable. Only the lowest ``k + 1`` ids
of a vector can ever appear in a list, so each vector enters once with those ids.
A vector with a missing component is near to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cohortline.operators.ranks import hash_int
from cohortline.session import materialize

LEAF_ROWS = 1024
CELL_ROWS = 512
SAMPLE_PER_LEAF = 32
SAMPLE_ROWS = 1 << 15  # of a tree, or of one leaf that is split again
MAX_LEVELS = 12
QUERIES_PER_TASK = 200_000
CELLS_AT_ONCE = 1 << 20
CELLS_HELD = 64  # cells of other groups that are looked into at once
PENDING = 1 << 15  # found ids that wait to be merged
NEAR = "array<struct<d2:double,id:bigint>>"


class Tree:
    """Median splits: inner nodes go left below ``cut``, leaves have ``dim`` -1 and a number."""

    def __init__(self):
        self.dim, self.cut, self.left, self.right = [-1], [0.0], [-1], [-1]

    def grow(self, node: int, points: np.ndarray, leaves: int) -> None:
        """Split a leaf into about so many."""
        spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
        if leaves <= 1 or len(points) < 2 or not spread.max() > 0:
            return
        dim = int(spread.argmax())
        x = points[:, dim]
        cut = float(np.median(x))
        if not (x < cut).any():
            cut = float(x[x > x.min()].min())
        low = x < cut
        at = len(self.dim)
        self.dim += [-1, -1]
        self.cut += [0.0, 0.0]
        self.left += [-1, -1]
        self.right += [-1, -1]
        self.dim[node], self.cut[node], self.left[node], self.right[node] = dim, cut, at, at + 1
        self.grow(at, points[low], leaves // 2)
        self.grow(at + 1, points[~low], leaves - leaves // 2)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(a) for a in (self.dim, self.cut, self.left, self.right))


def _leaf_of(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The leaf node of each row."""
    dim, cut, left, right = tree
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while True:
        rows = rows[dim[at[rows]] >= 0]
        if not len(rows):
            return at
        node = at[rows]
        at[rows] = np.where(x[rows, dim[node]] < cut[node], left[node], right[node])


def _box_distances(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each row from each box."""
    out = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        gap = np.maximum(np.maximum(low[:, j] - x[:, j:j + 1], x[:, j:j + 1] - high[:, j]), 0.0)
        out += gap * gap
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype("float64") if len(column) else np.zeros((0, 1))


class Cell:
    """Some points that lie together, each with its ids."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        self.points, self.sizes, self.ids = points, sizes, ids
        self.low, self.high = points.min(axis=0), points.max(axis=0)
        self.first = np.cumsum(sizes) - sizes

    @cached_property
    def products(self) -> tuple[np.ndarray, float, np.ndarray, float]:
        """The middle and a unit (a power of two), what rows ``(x, 1, x * x)`` in these terms are multiplied with to give
        squared distances, and the largest square."""
        middle = self.low / 2 + self.high / 2
        unit = float(np.exp2(np.ceil(np.log2(max(np.abs(self.points - middle).max(), 1e-150)))))
        y = (self.points - middle) / unit
        square = (y * y).sum(axis=1)
        return middle, unit, np.column_stack([-2.0 * y, square, np.ones(len(y))]).T.astype(np.float32), square.max()

    def within(self, x: np.ndarray, reach: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``x`` and points that may lie within reach, and the reach, no longer than the ``want``-th point's distance.

        Products in single precision only choose: their rounding is bounded, and what leaves their range is chosen.
        """
        middle, unit, right, largest = self.products
        with np.errstate(over="ignore", invalid="ignore"):
            q = (x - middle) / unit
            square = (q * q).sum(axis=1)
            left = np.empty((len(x), x.shape[1] + 2), np.float32)
            left[:, :-2], left[:, -2], left[:, -1] = q, 1.0, square
            away = left @ right
            slack = (x.shape[1] + 8) * 1.2e-7 * (square + largest) + 1e-30
            endless = np.flatnonzero(np.isinf(reach))
            if len(endless) and len(self.points) >= want:
                edge = np.partition(away[endless], want - 1, axis=1)[:, want - 1]
                reach = reach.copy()
                reach[endless] = np.where(np.isfinite(edge), (edge + slack[endless]) * unit ** 2, np.inf)
            limit = (reach / unit ** 2 * (1 + 1e-5) + slack).astype(np.float32)
            row, point = np.divmod(np.flatnonzero(~(away > limit[:, None])), len(self.points))
        return row, point, reach


class Points:
    """Points in cells."""

    def __init__(self, pdf: pd.DataFrame, cell_rows: int = 0):
        points = _matrix(pdf["vec"])
        sizes = pdf["ids"].map(len).to_numpy().astype("int64")
        first = np.cumsum(sizes) - sizes
        ids = np.concatenate(pdf["ids"].to_numpy()).astype("int64")
        tree = Tree()
        tree.grow(0, points, -(-len(points) // (cell_rows or CELL_ROWS)))
        cell = _leaf_of(points, tree.arrays())
        order = np.argsort(cell, kind="stable")
        self.rows = np.split(order, np.flatnonzero(np.diff(cell[order])) + 1)
        self.cells = [Cell(points[r], sizes[r], np.concatenate([ids[first[i]:first[i] + sizes[i]] for i in r])) for r in self.rows]

    def nearest(self, queries: np.ndarray, reach: np.ndarray, want: int) -> Nearest:
        """Up to ``want`` ids per query, none farther than its ``reach``."""
        found = Nearest(reach, want)
        found.search(queries, self.cells)
        return found


class Nearest:
    """Per query the first ``want`` by distance and then id; ``reach`` is the last one's distance once there are so many."""

    def __init__(self, reach: np.ndarray, want: int):
        self.reach, self.want = reach.astype(float).copy(), want
        self.d2, self.id = np.full((len(reach), want), np.inf), np.zeros((len(reach), want), np.int64)
        self.size, self.visits = np.zeros(len(reach), np.int64), np.zeros(len(reach), np.int64)
        self.pending: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def search(self, x: np.ndarray, cells: Sequence[Cell]) -> None:
        """Look for all queries' nearest in some cells."""
        low, high = np.array([c.low for c in cells]), np.array([c.high for c in cells])
        step = max(1, CELLS_AT_ONCE // len(cells))
        for at in range(0, len(x), step):
            here = slice(at, at + step)
            away = _box_distances(x[here], low, high)
            closest = away.argmin(axis=1)
            # the closest cell of each query first, so that the others are held against what it has
            for again in (False, True):
                self.settle()
                for c, cell in enumerate(cells):
                    # a hair of slack, so rounding in the box distance can only add a visit
                    asked = np.flatnonzero((closest != c if again else closest == c) & ~(away[:, c] > self.reach[here] * (1 + 1e-9)))
                    block = max(1, CELLS_AT_ONCE // len(cell.points))
                    for k in range(0, len(asked), block):
                        self.visit(at + asked[k:k + block], x, cell)
        self.settle()

    def visit(self, rows: np.ndarray, x: np.ndarray, cell: Cell) -> None:
        """Take from a cell what some queries (each once) may need."""
        self.visits[rows] += 1
        x = x[rows]
        row, point, self.reach[rows] = cell.within(x, self.reach[rows], self.want)
        d2 = np.zeros(len(row))
        for j in range(x.shape[1]):  # a fixed order of summation keeps equal distances equal
            gap = x[row, j] - cell.points[point, j]
            d2 += gap * gap
        near = np.flatnonzero(d2 <= self.reach[rows[row]])
        row, point, d2 = row[near], point[near], d2[near]
        times = cell.sizes[point]
        part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        self.pending.append((np.repeat(rows[row], times), np.repeat(d2, times), cell.ids[np.repeat(cell.first[point], times) + part]))
        self.held += len(part)
        if self.held > PENDING:
            self.settle()

    def settle(self) -> None:
        """Merge what was found into the lists of those queries that found something."""
        if not self.held:
            self.pending = []
            return
        row, d2, ids = (np.concatenate(c) for c in zip(*self.pending))
        self.pending, self.held = [], 0
        some = np.flatnonzero(np.bincount(row, minlength=len(self.reach)))
        kept = np.arange(self.want) < self.size[some, None]
        row = np.concatenate([np.repeat(some, self.size[some]), row])
        d2, ids = np.concatenate([self.d2[some][kept], d2]), np.concatenate([self.id[some][kept], ids])
        order = np.lexsort((ids, d2, row))
        row, d2, ids = row[order], d2[order], ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.want
        row, rank = row[keep], rank[keep]
        self.d2[row, rank], self.id[row, rank] = d2[keep], ids[keep]
        self.size[some] = np.minimum(np.bincount(row, minlength=len(self.reach))[some], self.want)
        full = some[self.size[some] == self.want]
        self.reach[full] = np.minimum(self.reach[full], self.d2[full, -1])

    def lists(self, queries: int) -> list[list[tuple[float, int]]]:
        self.settle()
        return [list(zip(self.d2[i, :n].tolist(), self.id[i, :n].tolist())) for i, n in enumerate(self.size[:queries])]


def fit_tree(vectors: DataFrame, n: int, leaf_rows: int) -> tuple[tuple[np.ndarray, ...], pd.DataFrame]:
    """The tree over ``(vid, vec)``, and per leaf its number of rows and box."""
    dims = len(vectors.select("vec").first()[0])
    tree, oversize = Tree(), {0: n}
    for _ in range(MAX_LEVELS):
        grown = _grown(vectors, tree, oversize, leaf_rows)
        boxes = _placed(vectors, tree.arrays()).groupBy("leaf").agg(
            F.count("*").alias("n"), *[f(F.col("vec")[j]).alias(f"{k}{j}") for j in range(dims)
                                       for k, f in (("lo", F.min), ("hi", F.max))]).orderBy("leaf").toPandas()
        oversize = {int(r): int(c) for r, c in zip(boxes["leaf"], boxes["n"]) if c > 2 * leaf_rows}
        if not grown or not oversize:
            break
    return tree.arrays(), boxes


def _placed(vectors: DataFrame, tree: tuple[np.ndarray, ...]) -> DataFrame:
    @F.pandas_udf("int")
    def leaf(vec: pd.Series) -> pd.Series:
        return pd.Series(_leaf_of(_matrix(vec), tree), dtype="int32")

    return vectors.withColumn("leaf", leaf("vec"))


def _grown(vectors: DataFrame, tree: Tree, oversize: dict[int, int], leaf_rows: int) -> bool:
    """Split the leaves named with their sizes, each by a tree learned on a sample of its own; whether any was split."""
    before = len(tree.dim)
    wanted = {leaf: min(-(-n // leaf_rows), SAMPLE_ROWS // SAMPLE_PER_LEAF) for leaf, n in oversize.items()}
    wanted = {leaf: k for leaf, k in wanted.items() if k > 1}
    if not wanted:
        return False
    share = {leaf: min(1.0, SAMPLE_PER_LEAF * k / oversize[leaf]) for leaf, k in wanted.items()}
    if before == 1:
        picked = vectors.filter(hash_int(F.col("vid"), "leaf") < F.lit(int(share[0] * (1 << 60))))
        tree.grow(0, _matrix(picked.select("vec").toPandas()["vec"]), wanted[0])
        return len(tree.dim) > before
    limits = np.zeros(before)
    limits[list(share)] = list(share.values())
    levels = len(tree.dim)
    arrays = tree.arrays()

    @F.pandas_udf("double")
    def limit(leaf: pd.Series) -> pd.Series:
        return pd.Series(limits[leaf.to_numpy()])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        own, leaf = Tree(), int(pdf["leaf"].iloc[0])
        own.grow(0, _matrix(pdf["vec"]), wanted[leaf])
        dim, cut, left, right = own.arrays()
        return pd.DataFrame({"leaf": leaf, "node": np.arange(len(dim)), "dim": dim, "cut": cut, "l": left, "r": right})

    sampled = _placed(vectors, arrays).filter(
        hash_int(F.col("vid"), F.lit(levels), "leaf") < (limit("leaf") * float(1 << 60)).cast("bigint"))
    found = sampled.groupBy("leaf").applyInPandas(learn, "leaf int, node int, dim int, cut double, l int, r int").toPandas()
    for leaf, nodes in found.sort_values(["leaf", "node"]).groupby("leaf"):
        # the subtree's root takes the leaf's place, its other nodes follow at the end
        shift = len(tree.dim) - 1
        place = lambda k: int(leaf) if k == 0 else int(k) + shift
        for dim, cut, left, right in zip(nodes["dim"], nodes["cut"], nodes["l"], nodes["r"]):
            values = int(dim), float(cut), place(left) if dim >= 0 else -1, place(right) if dim >= 0 else -1
            for column, v in zip((tree.dim, tree.cut, tree.left, tree.right), values):
                column.append(v)
        for column in (tree.dim, tree.cut, tree.left, tree.right):
            column[int(leaf)] = column.pop(shift + 1)
    return len(tree.dim) > before


def leaf_groups(tree: tuple[np.ndarray, ...], boxes: pd.DataFrame, groups: int) -> np.ndarray:
    """For each node the number of its group: leaves next to each other in the tree, about as many points in each group."""
    dim, _, left, right = tree
    sizes = np.zeros(len(dim), np.int64)
    sizes[boxes["leaf"].to_numpy()] = boxes["n"].to_numpy()
    order, stack = [], [0]
    while stack:
        node = stack.pop()
        if dim[node] < 0:
            order.append(node)
        else:
            stack += [right[node], left[node]]
    out = np.zeros(len(dim), np.int64)
    middle = np.cumsum(sizes[order]) - sizes[order] / 2
    out[order] = np.minimum(middle * groups // max(1, sizes.sum()), groups - 1)
    return out


CELL = ("grp long, cell long, vid binary, vec binary, sizes binary, ids binary, d2 binary, near binary, found binary, "
        "low array<double>, high array<double>, reach double")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each group, one after another, from rows sorted by ``grp``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        group = batch.column("grp").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for a, b in zip(cuts, cuts[1:]):
            if held and b > a and held[-1].column("grp")[0].as_py() != group[a]:
                yield held[-1].column("grp")[0].as_py(), pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield held[-1].column("grp")[0].as_py(), pa.Table.from_batches(held)


def vector_neighbors(vectors: DataFrame, k: int, leaf_rows: int = LEAF_ROWS, visits: list[tuple[int, int]] | None = None) -> DataFrame:
    """For each distinct vector ``(vid, vec, ids)`` without missing components its ``k + 1`` nearest ids, itself included:
    ``(vid, near array<struct<d2, id>>)``. ``visits`` collects the points and cell visits beyond their group."""
    want, spark = k + 1, vectors.sparkSession
    # read by every step below
    vectors = materialize(vectors.filter(~F.exists("vec", lambda x: x.isNull() | F.isnan(x))), "vectors")
    n = vectors.count()
    if not n:
        return vectors.select("vid", F.lit(None).cast(NEAR).alias("near"))
    tree, boxes = fit_tree(vectors, n, leaf_rows)
    groups = min(len(boxes), max(2 * spark.sparkContext.defaultParallelism, -(-n // QUERIES_PER_TASK)))
    group_of = leaf_groups(tree, boxes, groups)
    # more partitions than groups, so that few groups share one
    tasks = 4 * groups

    @F.pandas_udf("long")
    def group(vec: pd.Series) -> pd.Series:
        return pd.Series(group_of[_leaf_of(_matrix(vec), tree)])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the points of a group find in it, cell by cell."""
        for number, rows in _grouped(batches):
            pdf = rows.to_pandas()
            held, vid = Points(pdf), pdf["vid"].to_numpy()
            x = np.concatenate([c.points for c in held.cells])
            near = Nearest(np.full(len(x), np.inf), want)
            near.search(x, held.cells)
            at = 0
            for c, (own, cell) in enumerate(zip(held.rows, held.cells)):
                here = slice(at, at := at + len(own))
                blobs = [vid[own].astype("int64"), cell.points, cell.sizes, cell.ids, near.d2[here], near.id[here], near.size[here]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()), pa.array([number << 32 | c], pa.int64()), *[pa.array([b.tobytes()], pa.binary()) for b in blobs],
                    *[pa.array([b.tolist()], pa.list_(pa.float64())) for b in (cell.low, cell.high)], pa.array([near.reach[here].max()])],
                    names=[c.split()[0] for c in CELL.split(", ")])

    placed = vectors.select(group("vec").alias("grp"), "vid", "vec", "ids").repartition(tasks, "grp").sortWithinPartitions("grp", "vid")
    state = materialize(placed.mapInArrow(inside, CELL), "cells")
    done = state.select("grp", "cell", "vid", "vec", "sizes", "ids", "d2", "near", "found", F.lit(0.0).alias("away"), F.lit(False).alias("asked"))
    if groups > 1:
        cells = state.select("cell", "grp", "low", "high").orderBy("cell").toPandas()
        low, high, numbers, owner = _matrix(cells["low"]), _matrix(cells["high"]), cells["cell"].to_numpy(), cells["grp"].to_numpy()

        def asking(pdf: pd.DataFrame) -> pd.DataFrame:
            """The cells of other groups that lie within reach of a cell of this one."""
            nearest = np.full(len(numbers), np.inf)
            own_low, own_high = _matrix(pdf["low"]), _matrix(pdf["high"])
            for lo, hi, reach in zip(own_low, own_high, pdf["reach"]):
                gap = np.maximum(np.maximum(low - hi, lo - high), 0.0)
                away = (gap * gap).sum(axis=1)
                np.minimum(nearest, np.where(away > reach * (1 + 1e-9), np.inf, away), out=nearest)
            own = pdf["grp"].iloc[0]
            some = np.flatnonzero((owner != own) & (nearest < np.inf))
            return pd.DataFrame({"grp": own, "cell": numbers[some], "away": nearest[some]})

        asks = state.select("grp", "low", "high", "reach").groupBy("grp").applyInPandas(asking, "grp long, cell long, away double")
        asks = materialize(asks, "asks")
        sent = state.select("cell", "vec", "sizes", "ids").join(asks, "cell").withColumn("asked", F.lit(True))
        done = done.unionByName(sent, allowMissingColumns=True)

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The points of a group against the cells that it asks for, the nearest first."""
        held, x, vid, near, waiting = None, None, None, None, []

        def cell(row: dict) -> Cell:
            sizes = np.frombuffer(row["sizes"], np.int64)
            return Cell(np.frombuffer(row["vec"], np.float64).reshape(len(sizes), -1), sizes, np.frombuffer(row["ids"], np.int64))

        def begin(rows: list[dict]) -> None:
            nonlocal x, vid, near
            x = np.concatenate([np.frombuffer(r["vec"], np.float64).reshape(len(r["vid"]) // 8, -1) for r in rows])
            vid, size, d2, ids = (np.concatenate([np.frombuffer(r[c], kind) for r in rows])
                                  for c, kind in (("vid", np.int64), ("found", np.int64), ("d2", np.float64), ("near", np.int64)))
            d2 = d2.reshape(-1, want)
            near = Nearest(np.where(size == want, d2[:, -1], np.inf), want)
            near.d2, near.id, near.size = d2, ids.reshape(-1, want), size

        def ended() -> pa.RecordBatch:
            if near is None:
                begin(own)
            if waiting:
                near.search(x, waiting)
            there = np.arange(want) < near.size[:, None]
            pairs = pa.StructArray.from_arrays([pa.array(near.d2[there]), pa.array(near.id[there])], ["d2", "id"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(near.size)]), pa.int32()), pairs)
            return pa.RecordBatch.from_arrays([pa.array(vid), lists, pa.array(near.visits)], ["vid", "near", "visits"])

        own: list[dict] = []
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                if row["grp"] != held:
                    if held is not None:
                        yield ended()
                    held, near, waiting, own = row["grp"], None, [], []
                if not row["asked"]:
                    own.append(row)
                    continue
                if near is None:
                    begin(own)
                waiting.append(cell(row))
                if len(waiting) >= CELLS_HELD:
                    near.search(x, waiting)
                    waiting = []
        if held is not None:
            yield ended()

    done = done.repartition(tasks, "grp").sortWithinPartitions("grp", "asked", "away", "cell")
    found = done.select("grp", "asked", "vid", "vec", "sizes", "ids", "d2", "near", "found").mapInArrow(beyond, f"vid long, near {NEAR}, visits long")
    if visits is not None:
        found = materialize(found, "neighbors")
        visits.append(found.agg(F.count("*"), F.sum("visits")).first()[:])
    return found.select("vid", "near")


def nearest_neighbors(df: DataFrame, id_col: str, features: Sequence[str], k: int = 5,
                      leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``(id, rank, neighbor_id, d2)`` for every row: its ``k`` nearest other rows by squared Euclidean distance."""
    points = df.select(F.col(id_col).cast("bigint").alias("id"),
                       F.array(*[F.col(f"`{c}`").cast("double") + F.lit(0.0) for c in features]).alias("vec"))
    # the row-number limit is applied before the shuffle, so copies of one vector stay few
    first = (points.withColumn("rn", F.row_number().over(W.partitionBy("vec").orderBy("id")))
             .filter(F.col("rn") <= k + 1))
    vectors = first.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(
        F.col("ids")[0].alias("vid"), "vec", "ids")
    near = vector_neighbors(vectors, k, leaf_rows)
    by_vec = vectors.select("vid", "vec").join(near, "vid")
    listed = points.join(by_vec, "vec").select("id", F.slice(F.filter(
        "near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return listed.select("id", F.posexplode("near").alias("rank", "x")).select(
        "id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("neighbor_id"), F.col("x.d2").alias("d2"))
