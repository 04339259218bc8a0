"""Fitted scores as functions of feature arrays, with exact ways to average them over mixtures of rows.

An attribution compares a row with background rows: for a set of features, the score
of the background rows with these features taken from the row. No score here needs
the mixed rows themselves. A forest's leaf is reached by a mixture exactly if every
feature on its path lies in the leaf's interval in whichever row it comes from, so a
leaf adds to the attributions by two counts only: features that fit in the row alone,
and in the background row alone. Squared distances and projections of kernels add up
over features, so a mixture's kernel values are products (or sums of products) of the
row's and the background's part.

``attributions`` gives the Shapley values of forests, ``coalition_values`` the mean score
for some coalitions of other scores. Missing features take
their fill value. All work in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np

CELLS_AT_ONCE = 1 << 20
PAIR_CELLS = 1 << 17  # coalition values that are worked on at once
MOST_FEATURES = 20  # 2**20 coalitions


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-z))


@dataclass(frozen=True)
class Scaling:
    """The preparation of features: fill what is missing, then ``(x - low) / span``."""

    low: np.ndarray
    span: np.ndarray
    fill: np.ndarray

    @staticmethod
    def of(state: Sequence[dict]) -> Scaling:
        """From preparation state rows in the order of the features."""
        known = [r["low"] is not None for r in state]
        low = [r["low"] if k else 0.0 for r, k in zip(state, known)]
        span = [((r["high"] - r["low"]) or 1.0) if k else np.inf for r, k in zip(state, known)]
        fill = [r["mean"] if r["mean"] is not None else 0.0 for r in state]
        return Scaling(np.array(low), np.array(span), np.array(fill))

    @staticmethod
    def none(features: int) -> Scaling:
        return Scaling(np.zeros(features), np.ones(features), np.zeros(features))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (np.where(np.isnan(x), self.fill, x) - self.low) / self.span


class LinearScore:
    """The logistic curve over a linear function; missing features take their fill value."""

    def __init__(self, weights: Sequence[float], bias: float, fill: Sequence[float] | None = None):
        self.weights = np.asarray(weights, np.float64)
        self.bias = float(bias)
        self.fill = np.zeros(len(self.weights)) if fill is None else np.asarray(fill, np.float64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return logistic(np.where(np.isnan(x), self.fill, x) @ self.weights + self.bias)

    def coalition_values(self, rows: np.ndarray, background: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Mean score of each row under each coalition: the row's own part and the background's add up."""
        own = np.where(np.isnan(rows), self.fill, rows) * self.weights
        other = np.where(np.isnan(background), self.fill, background) * self.weights
        rest = ~masks @ other.T + self.bias
        mine = own @ masks.T
        if max(np.abs(rest).max(initial=0), np.abs(mine).max(initial=0)) > 300:
            # the two parts' exponentials might leave the range of doubles
            return np.stack([logistic(rest + m[:, None]).mean(axis=1) for m in mine]) if len(mine) else mine
        np.exp(-rest, out=rest)
        np.exp(-mine, out=mine)
        out, held = np.empty_like(mine), np.empty_like(rest)
        for i, m in enumerate(mine):
            np.multiply(rest, m[:, None], out=held)
            held += 1.0
            np.reciprocal(held, out=held)
            out[i] = held.mean(axis=1)
        return out


class ForestScore:
    """Mean leaf value over trees, of prepared features, under a logistic curve if the forest is calibrated.

    Each leaf is one value and, per feature on its path, an interval ``low < x <= high``:
    arrays ``feature, low, high`` of all leaves end to end, with ``start`` giving each leaf's first place.
    """

    def __init__(self, scaling: Scaling, start: np.ndarray, feature: np.ndarray, low: np.ndarray, high: np.ndarray,
                 value: np.ndarray, trees: int, platt: tuple[float, float] | None = None):
        self.scaling, self.start, self.feature, self.low, self.high = scaling, start, feature, low, high
        self.value, self.platt = value / trees, platt

    @staticmethod
    def of_nodes(trees: Sequence[Sequence[dict]], scaling: Scaling, platt: tuple[float, float] | None = None) -> ForestScore:
        """From each tree's nodes ``{"id", "left", "right", "feature", "threshold", "value"}``; a leaf has ``left`` below 0."""
        start, feature, low, high, value = [0], [], [], [], []
        for nodes in trees:
            by_id = {n["id"]: n for n in nodes}
            stack: list[tuple[int, dict[int, tuple[float, float]]]] = [(min(by_id), {})]
            while stack:
                at, path = stack.pop()
                n = by_id[at]
                if n["left"] < 0:
                    for f, (a, b) in sorted(path.items()):
                        feature.append(f)
                        low.append(a)
                        high.append(b)
                    start.append(len(feature))
                    value.append(n["value"])
                    continue
                f, t = n["feature"], n["threshold"]
                a, b = path.get(f, (-np.inf, np.inf))
                stack.append((n["left"], path | {f: (a, min(b, t))}))
                stack.append((n["right"], path | {f: (max(a, t), b)}))
        return ForestScore(scaling, np.array(start), np.array(feature, np.int64), np.array(low), np.array(high),
                           np.array(value), len(trees), platt)

    def leaves(self):
        """Features, bounds and value of each leaf."""
        for k in range(len(self.value)):
            at = slice(self.start[k], self.start[k + 1])
            yield self.feature[at], self.low[at], self.high[at], self.value[k]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = self.scaling(x)
        out = np.zeros(len(x))
        for f, low, high, value in self.leaves():
            out += value * ((x[:, f] > low) & (x[:, f] <= high)).all(axis=1)
        return out if self.platt is None else logistic(self.platt[0] * out + self.platt[1])

    def _patterns(self, x: np.ndarray, f: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which of a leaf's features fit it, as the bits of a number per row."""
        fits = (x[:, f] > low) & (x[:, f] <= high)
        return fits @ (1 << np.arange(len(f), dtype=np.int64)) if len(f) else np.zeros(len(x), np.int64)

    @property
    def additive(self) -> bool:
        """Whether the score is a plain sum over leaves."""
        return self.platt is None

    def attributions(self, rows: np.ndarray, background: np.ndarray) -> np.ndarray:
        """Exact Shapley values against the background rows, one row each.

        Without calibration, a leaf with A features that fit in the row alone and B in the background row alone (and none in neither)
        gives each of the former ``(A - 1)! B! / (A + B)!`` of its value, takes ``A! (B - 1)! / (A + B)!`` from the latter.
        """
        if not self.additive:
            return self._calibrated(rows, background)
        rows, background = self.scaling(rows), self.scaling(background)
        phi = np.zeros(rows.shape)
        most = int(np.diff(self.start).max(initial=0))
        fact = [float(factorial(k)) for k in range(most + 1)]
        gain, loss = np.zeros((most + 1, most + 1)), np.zeros((most + 1, most + 1))
        for a in range(most + 1):
            for b in range(most + 1 - a):
                gain[a, b] = fact[a - 1] * fact[b] / fact[a + b] if a else 0.0
                loss[a, b] = fact[a] * fact[b - 1] / fact[a + b] if b else 0.0
        for f, low, high, value in self.leaves():
            if not len(f) or not value:
                continue
            full = (1 << len(f)) - 1
            mine, place = np.unique(self._patterns(rows, f, low, high), return_inverse=True)
            theirs, times = np.unique(self._patterns(background, f, low, high), return_counts=True)
            reached = (mine[:, None] | theirs) == full
            if not reached.any():
                continue
            share = np.where(reached, times * (value / len(background)), 0.0)
            alone, other = mine[:, None] & ~theirs, theirs & ~mine[:, None]
            a, b = np.bitwise_count(alone), np.bitwise_count(other)
            plus, minus = share * gain[a, b], share * loss[a, b]
            bits = np.arange(len(f))
            part = np.einsum("xb,xbf->xf", plus, (alone[:, :, None] >> bits) & 1) - np.einsum("xb,xbf->xf", minus, (other[:, :, None] >> bits) & 1)
            phi[:, f] += part[place]
        return phi

    def _calibrated(self, rows: np.ndarray, background: np.ndarray) -> np.ndarray:
        """Exact Shapley values under the logistic curve: the forest's value for every coalition, then the curve.

        A leaf counts for the coalitions that hold ``need`` (what fits in the row alone) and nothing of ``bar`` (what fits
        in the background row alone). Features in no ``need`` or ``bar`` of a row and a background row change nothing
        between the two, so each pair has coalitions of its other features only.
        """
        p, m = rows.shape[1], len(background)
        if p > MOST_FEATURES:
            raise ValueError(f"{p} features have too many coalitions: ask for permutations")
        rows, background = self.scaling(rows), self.scaling(background)
        long = np.flatnonzero(np.diff(self.start) > 0)
        first, value = self.start[long], self.value[long]
        phi = np.zeros(rows.shape)
        if not len(first):
            return phi
        constant = float(self.value[np.diff(self.start) == 0].sum())
        bit = np.int32(1) << self.feature.astype(np.int32)

        def patterns(x: np.ndarray) -> np.ndarray:
            fits = (x[:, self.feature] > self.low) & (x[:, self.feature] <= self.high)
            return np.add.reduceat(fits * bit, first, axis=1, dtype=np.int32)

        full = np.add.reduceat(bit, first, dtype=np.int32)
        theirs = patterns(background)
        step = max(1, CELLS_AT_ONCE // theirs.size)
        for at in range(0, len(rows), step):
            mine = patterns(rows[at:at + step])
            pair, leaf = np.divmod(np.flatnonzero((mine[:, None] | theirs) == full), len(full))
            x, b = np.divmod(pair, m)
            own, other = mine[x, leaf], theirs[b, leaf]
            apart = self._pairs(pair, own & ~other, other & ~own, value[leaf], len(mine) * m, p, constant)
            phi[at:at + step] = apart.reshape(-1, m, p).mean(axis=1)
        return phi

    def _pairs(self, pair: np.ndarray, need: np.ndarray, bar: np.ndarray, value: np.ndarray, pairs: int, p: int,
               constant: float) -> np.ndarray:
        """Shapley values of each pair of a row and a background row, from the leaves that count, ordered by pair."""
        used = np.zeros(pairs, np.int32)
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        used[pair[starts]] = np.bitwise_or.reduceat(need | bar, starts)
        size = np.bitwise_count(used)
        # pairs of one size are worked on together, and features numbered within their pair
        order = np.argsort(size, kind="stable")
        place = np.empty(pairs, np.int64)
        place[order] = np.arange(pairs)
        term = np.argsort(place[pair], kind="stable")
        pair, need, bar, value = pair[term], need[term], bar[term], value[term]
        sides, packed = need | bar.astype(np.int64) << 32, np.zeros(len(pair), np.int64)
        for j in range(p):
            turn = np.bitwise_count(used & np.int32((1 << j) - 1)).astype(np.int64)
            packed |= (sides >> j & (1 << 32 | 1)) << turn[pair]
        near, far = packed.astype(np.int32), (packed >> 32).astype(np.int32)
        column, slope = place[pair], self.platt[0]
        # as powers the leaves' parts are multiplied, unless they might leave the range of doubles
        powers = abs(slope) * np.bincount(column, np.abs(value) * 2.0 ** np.bitwise_count(far)).max() < 300
        base = self.platt[0] * constant + self.platt[1]
        phi = np.zeros((pairs, p))
        at = 0
        while at < pairs:
            k = int(size[order[at]])
            end = min(int(np.searchsorted(size[order], k, side="right")), at + max(1, PAIR_CELLS >> k))
            here = slice(*np.searchsorted(column, [at, end]))
            if k:
                n = end - at
                leaf, sets, sign = expanded(near[here], far[here])
                cell, weight = sets.astype(np.int64) * n + (column[here] - at)[leaf], sign * (slope * value[here])[leaf]
                if powers:
                    values = np.ones((1 << k, n))
                    values[0] = np.exp(-base)
                    np.multiply.at(values.reshape(-1), cell, np.exp(-weight))
                    below(values, k, np.multiply)
                    values += 1.0
                    np.reciprocal(values, out=values)
                else:
                    values = np.bincount(cell, weight, n << k).reshape(1 << k, n)
                    below(values, k, np.add)
                    values = logistic(values + base)
                # numbers of features within a pair, from the lowest bit on
                row, feature = np.nonzero(used[order[at:end], None] >> np.arange(p) & 1)
                phi[order[at:end][row], feature] = shapley_sums(values, k).T.ravel()
            at = end
        return phi


def expanded(need: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signed sets whose sums over subsets count what holds ``need`` and nothing of ``bar``: the place of the two, the set, the sign."""
    times = np.int64(1) << np.bitwise_count(bar).astype(np.int64)
    at = np.repeat(np.arange(len(need)), times)
    part = (np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32)
    sets, rest = need[at], bar.copy()
    for k in range(int(times.max(initial=1)).bit_length() - 1):
        lowest = rest & -rest
        rest ^= lowest
        sets |= lowest[at] * (part >> k & 1)
    return at, sets, 1.0 - 2.0 * (np.bitwise_count(part) & 1)


def below(table: np.ndarray, k: int, join: np.ufunc) -> None:
    """In place, each row of ``2**k`` joined with the rows of all its subsets."""
    for j in range(k):
        halves = table.reshape(-1, 2, table.shape[1] << j)
        join(halves[:, 1], halves[:, 0], out=halves[:, 1])


def shapley_sums(values: np.ndarray, k: int) -> np.ndarray:
    """Shapley values of ``k`` features, one row each, from the values of all coalitions; overwrites these."""
    size = np.bitwise_count(np.arange(1 << k))
    outside = np.array([factorial(s) * factorial(k - s - 1) / factorial(k) for s in range(k)] + [0.0])
    both = outside + ([0.0] + [factorial(s - 1) * factorial(k - s) / factorial(k) for s in range(1, k + 1)])
    lost = outside[size] @ values
    values *= both[size][:, None]
    out = np.empty((k, values.shape[1]))
    for j in reversed(range(k)):
        low, high = values[:1 << j], values[1 << j:2 << j]
        out[j] = high.sum(axis=0) - lost
        low += high
    return out


class LandmarkScore:
    """The logistic curve over a weighted sum of RBF kernels with landmarks, in prepared features."""

    def __init__(self, scaling: Scaling, landmarks: np.ndarray, weights: np.ndarray, bias: float, gamma: float):
        self.scaling, self.landmarks, self.weights, self.bias, self.gamma = scaling, landmarks, weights, bias, gamma

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = self.scaling(x)
        apart = (x * x).sum(1)[:, None] + (self.landmarks ** 2).sum(1) - 2 * x @ self.landmarks.T
        return logistic(np.exp(-self.gamma * np.maximum(apart, 0.0)) @ self.weights + self.bias)

    def coalition_values(self, rows: np.ndarray, background: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Mean score of each row under each coalition: a mixture's kernel value is the product of its two parts'."""
        own = (self.scaling(rows)[:, None, :] - self.landmarks) ** 2
        other = (self.scaling(background)[:, None, :] - self.landmarks) ** 2
        out = np.empty((len(rows), len(masks)))
        step = max(1, CELLS_AT_ONCE // (len(background) * len(self.landmarks)))
        for at in range(0, len(masks), step):
            part = masks[at:at + step].astype(np.float64)
            rest = np.exp(-self.gamma * np.einsum("bzf,sf->sbz", other, 1.0 - part))
            for i in range(len(rows)):
                mine = np.exp(-self.gamma * (part @ own[i].T)) * self.weights
                out[i, at:at + step] = logistic(np.matmul(rest, mine[:, :, None])[:, :, 0] + self.bias).mean(axis=1)
        return out


class PolynomialScore:
    """The logistic curve over a linear function of a polynomial kernel's monomials, in prepared features."""

    def __init__(self, scaling: Scaling, monomials, weights: np.ndarray, bias: float):
        self.scaling, self.monomials, self.weights, self.bias = scaling, monomials, weights, bias

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.monomials(self.scaling(x)) @ self.weights + self.bias)
