"""Linear classifiers, many at once: one pass over the rows serves every candidate on every training group.

A training group is a part of the rows with its own preparation and class weights,
such as all folds but one. Each task adds up, for every (group, candidate), the
objective, its gradient and its second derivatives; the sums are combined on the
executors (where there are many tasks) and only they reach the driver, which takes a Newton step for each model
by itself. The number of passes, and so of Spark jobs, is that of the slowest model
and does not grow with candidates or groups; what reaches the driver is bounded by
models times features squared, and ``CELLS_PER_PASS`` splits larger lots.

A group may map its prepared features to others (kernels); rows are mapped where they
are read, pass by pass, and nothing mapped is stored.

The objective is ``C * sum(weight * loss) + |w|^2 / 2`` with a free intercept (for a
kernel, the norm of the function in the kernel's space); the loss is logistic, or the hinge, approached through quadratically smoothed hinges of
shrinking width (the last one ``HINGE_WIDTH``, which the mean loss can be off by a
quarter of). A pass also finds the objective at ``SHORTER`` parts of the tried step,
so a step that goes too far is cut at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortline.functions.cleaning import quoted

CELLS_PER_PASS = 1 << 22
MAX_PASSES = 300
# of the objective; between widths of the hinge a rough end will do
TOLERANCE = {"logistic": 1e-12, "hinge": 1e-9}
ROUGH = 1e-5
DIRECT = 64  # partitions whose sums reach the driver one by one; those of more are combined first
WIDEST_HINGE, HINGE_WIDTH, HINGE_SHRINK = 2.0, 5e-3, 0.14
LONGEST_STEP = 1000.0  # sum over the weights
SHORTER = (0.5, 0.25, 0.12, 0.06, 0.03, 0.01, 0.003, 0.001)
ROWS_AT_ONCE = 8192


@dataclass(frozen=True)
class Group:
    """Rows of one training set: those whose tag is ``tag`` (or, with ``inside`` False, is not), or all rows.

    A feature is ``(x - low) / span``, a missing one ``(fill - low) / span``. ``total`` is the sum of all weights.
    """

    low: Sequence[float]
    span: Sequence[float]
    fill: Sequence[float]
    weights: tuple[float, float]
    total: float
    tag: int | None = None
    inside: bool = True
    mapping: Callable[[np.ndarray], np.ndarray] | None = None

    def prepared(self, x: np.ndarray) -> np.ndarray:
        z = (np.where(np.isnan(x), self.fill, x) - self.low) / self.span
        return z if self.mapping is None else self.mapping(z)

    def size(self) -> int:
        """How many weights a model of this group has, without the intercept."""
        return len(self.low) if self.mapping is None else self.mapping.size(len(self.low))

    def penalty(self) -> np.ndarray:
        """Squared norm of a model, as a matrix over its weights; the intercept is free."""
        out = np.zeros((self.size() + 1, self.size() + 1))
        out[:-1, :-1] = np.eye(self.size()) if self.mapping is None else self.mapping.penalty(len(self.low))
        return out

    def rows(self, tags: np.ndarray) -> np.ndarray:
        if self.tag is None:
            return np.ones(len(tags), bool)
        return (tags == self.tag) if self.inside else (tags != self.tag)


@dataclass(frozen=True)
class Candidate:
    loss: str  # "logistic" or "hinge"
    c: float


def group_of(state: Sequence[dict], sizes: dict[float, int], tag: int | None = None, inside: bool = True) -> Group:
    """A group from preparation state rows and class sizes, classes weighted to the same total."""
    n = float(sum(sizes.values()))
    present = [k for k in (0.0, 1.0) if sizes.get(k)]
    if len(present) < 2:
        raise ValueError("a training set needs rows of both classes")
    low = [r["low"] if r["low"] is not None else 0.0 for r in state]
    # a column without a value is 0 everywhere
    span = [((r["high"] - r["low"]) or 1.0) if r["low"] is not None else np.inf for r in state]
    fill = [r["mean"] if r["mean"] is not None else 0.0 for r in state]
    return Group(low, span, fill, (n / (2 * sizes[0.0]), n / (2 * sizes[1.0])), n, tag, inside)


@dataclass
class _Model:
    """Where a model's search stands: the last accepted point, and the step that is tried."""

    group: int
    candidate: Candidate
    point: np.ndarray
    width: float
    value: float = np.inf
    slope: float = 0.0
    step: np.ndarray = field(default=None)
    length: float = 0.0
    cut: bool = False  # the length is known to lower the objective
    done: bool = False

    def moved(self, part: float = 1.0) -> np.ndarray:
        return self.point if self.step is None else self.point + part * self.length * self.step

    def take(self, value: float, shorter: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> None:
        """Go on from the objective at the tried point and at parts of the way, and its derivatives at the tried point."""
        if self.step is not None and not self.cut and value > self.value + 1e-4 * self.length * self.slope:
            best = int(shorter.argmin())
            self.cut = bool(shorter[best] < self.value)
            self.length *= SHORTER[best] if self.cut else SHORTER[-1]
            if self.length * np.abs(self.step).max() < 1e-12:
                self.narrow()
            return
        self.point, self.value, self.cut = self.moved(), value, False
        damped = hessian + np.eye(len(gradient)) * (1e-10 + 1e-12 * np.trace(hessian))
        step = -np.linalg.solve(damped, gradient)
        self.slope = float(gradient @ step)
        rough = self.candidate.loss == "hinge" and self.width > HINGE_WIDTH
        if -self.slope <= (ROUGH if rough else TOLERANCE[self.candidate.loss]) * max(1.0, value):
            self.narrow()
            return
        self.step = step
        self.length = min(1.0, LONGEST_STEP / np.abs(step).sum())

    def narrow(self) -> None:
        """The search has ended at this width of the smoothed hinge; go on with the next one."""
        self.step, self.value = None, np.inf
        if self.candidate.loss == "logistic" or self.width <= HINGE_WIDTH:
            self.done = True
        else:
            self.width = max(HINGE_WIDTH, self.width * HINGE_SHRINK)


def _loss(kind: str, margin: np.ndarray, y: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of each row and its first and second derivative by the margin."""
    sign = 2.0 * y - 1.0
    if kind == "logistic":
        away = -sign * margin
        p = np.exp(-np.logaddexp(0.0, -away))  # chance of the other class
        return np.logaddexp(0.0, away), -sign * p, p * (1.0 - p)
    short = 1.0 - sign * margin
    inside = np.abs(short) < width
    near = short + width
    value = np.where(inside, near * near / (4 * width), np.maximum(short, 0.0))
    first = np.where(inside, near / (2 * width), (short > 0).astype(float))
    return value, -sign * first, np.where(inside, 1.0 / (2 * width), 0.0)


def _sums(x: np.ndarray, y: np.ndarray, tags: np.ndarray, groups: Sequence[Group], models: Sequence[tuple]) -> dict[int, np.ndarray]:
    """For each model ``(number, group, loss, width, point, before)``: the loss at its point and at parts of the way there from
    the point before, the gradient and the upper triangle of second derivatives."""
    out = {}
    by_group: dict[int, list[tuple]] = {}
    for m in models:
        by_group.setdefault(m[1], []).append(m)
    upper = np.triu_indices(len(models[0][4]))
    for g, mine in by_group.items():
        rows = groups[g].rows(tags)
        if not rows.any():
            continue
        z = np.column_stack([groups[g].prepared(x[rows]), np.ones(int(rows.sum()))])
        own = y[rows]
        weight = np.where(own > 0, groups[g].weights[1], groups[g].weights[0])
        margins = z @ np.stack([point for *_, point, _ in mine]).T
        starts = z @ np.stack([before for *_, before in mine]).T
        for (number, _, kind, width, point, before), margin, start in zip(mine, margins.T, starts.T):
            value, first, second = _loss(kind, margin, own, width)
            shorter = [0.0] * len(SHORTER) if point is before else [
                _loss(kind, start + k * (margin - start), own, width)[0] @ weight for k in SHORTER]
            bent = second * weight
            some = bent != 0
            hessian = (z[some] * bent[some][:, None]).T @ z[some]
            out[number] = np.concatenate([[value @ weight], shorter, (first * weight) @ z, hessian[upper]])
    return out


def _pass(rows: DataFrame, parts: int, groups: Sequence[Group], models: Sequence[tuple], features: int) -> dict[int, np.ndarray]:
    schema = pa.schema([("model", pa.int32()), ("cells", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                columns = [part.column(i).to_numpy(zero_copy_only=False) for i in range(part.num_columns)]
                x = np.column_stack(columns[2:]).astype(np.float64) if features else np.zeros((part.num_rows, 0))
                for k, v in _sums(x, columns[0], columns[1], groups, models).items():
                    totals[k] = totals[k] + v if k in totals else v
        for k, v in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v], pa.list_(pa.float64()))], schema=schema)

    sums = rows.mapInArrow(run, "model int, cells array<double>")
    out: dict[int, np.ndarray] = {}
    if parts <= DIRECT:
        found = sums.toArrow()
        for model, cells in zip(found.column("model").to_pylist(), found.column("cells")):
            own = cells.values.to_numpy()
            out[model] = out[model] + own if model in out else own
        return out
    cells = sums.select("model", F.posexplode("cells").alias("cell", "value"))
    found = cells.groupBy("model", "cell").agg(F.sum("value").alias("value")).toPandas()
    size = _cells(len(models[0][4]) - 1)
    for model, part in found.groupby("model"):
        out[int(model)] = np.zeros(size)
        out[int(model)][part["cell"].to_numpy()] = part["value"].to_numpy()
    return out


def _cells(weights: int) -> int:
    """Sums of one model: the objective, its gradient and its second derivatives."""
    return 1 + len(SHORTER) + (weights + 1) + (weights + 1) * (weights + 2) // 2


def fit_linear(rows: DataFrame, label: str, features: Sequence[str], groups: Sequence[Group], candidates: Sequence[Candidate],
               tag: str | None = None) -> dict[tuple[int, int], np.ndarray]:
    """Weights of the prepared features and, last, the intercept, for every (group, candidate).

    ``rows`` holds the label (0 or 1) and the features before a group's preparation, and is read once a pass.
    """
    for c in candidates:
        if c.loss not in ("logistic", "hinge") or not c.c > 0:
            raise ValueError(f"unknown loss or penalty: {c}")
    read = rows.select(quoted(label).cast("double").alias("y"),
                       (quoted(tag).cast("int") if tag else F.lit(0)).alias("tag"),
                       *[quoted(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    keys = [(g, c) for c in range(len(candidates)) for g in range(len(groups))]
    lot = max(1, CELLS_PER_PASS // _cells(max(g.size() for g in groups)))
    penalties = [g.penalty() for g in groups]
    found: dict[tuple[int, int], np.ndarray] = {}
    kept = read.persist()  # lost blocks are recomputed
    try:
        parts = kept.rdd.getNumPartitions()
        for at in range(0, len(keys), lot):
            found.update(_fit(kept, parts, len(features), groups, penalties, candidates, keys[at:at + lot]))
    finally:
        kept.unpersist()
    return found


def _fit(rows: DataFrame, parts: int, features: int, groups: Sequence[Group], penalties: Sequence[np.ndarray], candidates: Sequence[Candidate],
         keys: Sequence[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    size = len(penalties[0])
    models = [_Model(g, candidates[c], np.zeros(size), WIDEST_HINGE) for g, c in keys]
    upper = np.triu_indices(size)
    for _ in range(MAX_PASSES):
        running = [k for k, m in enumerate(models) if not m.done]
        if not running:
            break
        asked = [(k, models[k].group, models[k].candidate.loss, models[k].width, models[k].moved(), models[k].point) for k in running]
        for k, sums in _pass(rows, parts, groups, asked, features).items():
            m = models[k]
            total = groups[m.group].total
            penalty = penalties[m.group] / (m.candidate.c * total)
            shorter = [m.moved(k) for k in SHORTER]
            values = sums[1:1 + len(SHORTER)] / total + [0.5 * float(x @ penalty @ x) for x in shorter]
            at, rest = m.moved(), sums[1 + len(SHORTER):]
            pull = penalty @ at
            hessian = np.zeros((size, size))
            hessian[upper] = rest[size:] / total
            hessian = hessian + hessian.T - np.diag(np.diag(hessian)) + penalty
            m.take(sums[0] / total + 0.5 * float(at @ pull), values, rest[:size] / total + pull, hessian)
    return {key: m.point for key, m in zip(keys, models)}


def raw_weights(group: Group, point: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept for features as they come, missing ones replaced by the group's fill."""
    weights = point[:-1] / np.asarray(group.span, float)
    return weights, float(point[-1] - weights @ np.asarray(group.low, float))
