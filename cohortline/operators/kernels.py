"""Feature maps and landmarks of kernel machines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortline.functions.cleaning import quoted
from cohortline.operators.scores import Scaling

LANDMARKS, TOLERANCE = 512, 1e-2
POOL = 256
ROWS_AT_ONCE = 2048


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |x - y|^2) of all rows of ``x`` with all rows of ``y``."""
    apart = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2.0 * (x @ y.T)
    return np.exp(-gamma * np.maximum(apart, 0.0))


def monomials(x: np.ndarray, gamma: float, coef0: float, degree: int) -> np.ndarray:
    """Feature map of the polynomial kernel (gamma x.y + coef0)^degree, one row per row of ``x``.

    Each monomial of the scaled inputs carries the square root of its multinomial
    coefficient; a constant input of sqrt(coef0) adds the lower degrees.
    """
    x = x * np.sqrt(gamma)
    if coef0 > 0:
        x = np.column_stack([x, np.full(len(x), np.sqrt(coef0))])
    out = []
    for chosen in combinations_with_replacement(range(x.shape[1]), degree):
        ways = factorial(degree)
        for j in set(chosen):
            ways //= factorial(chosen.count(j))
        out.append(np.sqrt(ways) * x[:, list(chosen)].prod(axis=1))
    return np.stack(out, axis=1)


class PolynomialMap:
    """Monomials whose inner products are the polynomial kernel, exactly."""

    def __init__(self, gamma: float, coef0: float = 0.0, degree: int = 3):
        self.gamma, self.coef0, self.degree = gamma, coef0, degree

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return monomials(x, self.gamma, self.coef0, self.degree)

    def size(self, features: int) -> int:
        n = features + (self.coef0 > 0)
        return comb(n + self.degree - 1, self.degree)

    def penalty(self, features: int) -> np.ndarray:
        return np.eye(self.size(features))

    def payload(self) -> dict:
        return {"kernel": "poly", "gamma": self.gamma, "coef0": self.coef0, "degree": self.degree}


class LandmarkMap:
    """Kernel values with landmark rows: functions in their span, with the norm they have in the kernel's space."""

    def __init__(self, landmarks: np.ndarray, gamma: float):
        self.landmarks, self.gamma = np.asarray(landmarks, np.float64), gamma

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return rbf(x, self.landmarks, self.gamma)

    def size(self, features: int) -> int:
        return len(self.landmarks)

    def penalty(self, features: int) -> np.ndarray:
        return rbf(self.landmarks, self.landmarks, self.gamma)

    def payload(self) -> dict:
        return {"kernel": "rbf", "gamma": self.gamma, "landmarks": self.landmarks.tolist()}


def map_of(payload: dict) -> PolynomialMap | LandmarkMap | None:
    if payload["kernel"] == "poly":
        return PolynomialMap(payload["gamma"], payload["coef0"], payload["degree"])
    if payload["kernel"] == "rbf":
        return LandmarkMap(np.array(payload["landmarks"]), payload["gamma"])
    return None


def residuals(x: np.ndarray, landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """What is left of k(x, x) = 1 outside the span of the landmarks. No kernel value of two rows is
    approximated worse than the root of the product of theirs."""
    if not len(landmarks):
        return np.ones(len(x))
    near = rbf(x, landmarks, gamma)
    return 1.0 - (near * np.linalg.solve(rbf(landmarks, landmarks, gamma), near.T).T).sum(axis=1)


def choose_landmarks(rows: DataFrame, features: Sequence[str], scaling: Scaling, gamma: float, most: int = LANDMARKS,
                     tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Landmark rows (prepared) for an RBF kernel, and the largest error of a kernel value over all rows.

    In each round every task looks for the rows the landmarks explain least; the
    worst ``POOL`` of all rows are gone through greedily, the one with most left over
    first. Ends when no row has more than ``tolerance`` left, or ``most`` are chosen.
    """
    if most < 1 or tolerance <= 0:
        raise ValueError("at least one landmark and a positive tolerance are needed")
    names = [f"f{i}" for i in range(len(features))]
    read = rows.select(*[quoted(c).cast("double").alias(n) for c, n in zip(features, names)])
    schema = pa.schema([("left", pa.float64()), *[(n, pa.float64()) for n in names]])
    landmarks, error = np.zeros((0, len(features))), 1.0
    while True:
        known = landmarks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                    part = batch.slice(at, ROWS_AT_ONCE)
                    x = scaling(np.column_stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(part.num_columns)]).astype(float))
                    left = residuals(x, known, gamma)
                    some = np.flatnonzero(left > tolerance)
                    some = some[np.argsort(-left[some], kind="stable")][:POOL]
                    yield pa.RecordBatch.from_arrays([pa.array(left[some]), *[pa.array(c) for c in x[some].T]], schema=schema)

        worst = (read.mapInArrow(run, "left double, " + ", ".join(f"{n} double" for n in names))
                 .orderBy(F.desc("left"), *names).limit(POOL).toPandas())
        if not len(worst):
            return landmarks, min(error, tolerance)
        error = float(worst["left"].max())
        if len(landmarks) >= most:
            return landmarks, error
        landmarks = np.vstack([landmarks, _greedy(worst[names].to_numpy(), landmarks, gamma, most - len(landmarks), tolerance)])


def _greedy(pool: np.ndarray, landmarks: np.ndarray, gamma: float, most: int, tolerance: float) -> np.ndarray:
    """Rows of the pool, each the one that those before it explain least, until none has more than ``tolerance`` left."""
    parts = np.zeros((len(pool), 0))  # coordinates of the pool in the span of what is chosen
    if len(landmarks):
        root = np.linalg.cholesky(rbf(landmarks, landmarks, gamma))
        parts = np.linalg.solve(root, rbf(landmarks, pool, gamma)).T
    left = 1.0 - (parts * parts).sum(axis=1)
    chosen = []
    while len(chosen) < most:
        k = int(left.argmax())
        if left[k] <= tolerance:
            break
        chosen.append(k)
        column = (rbf(pool, pool[k:k + 1], gamma)[:, 0] - parts @ parts[k]) / np.sqrt(left[k])
        parts = np.column_stack([parts, column])
        left = left - column * column
    return pool[chosen]
