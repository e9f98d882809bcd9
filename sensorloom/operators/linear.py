"""Linear classifiers of many splits fitted together (M7, M8).

Logistic regression (softmax over K classes) and the linear SVM (squared hinge, one class
against the rest) are minimised by L-BFGS on the driver, which holds weights and never rows.
One evaluation is one pass over the rows for *all* problems that have not converged: a problem is a
split (logistic regression) or a split and a class (SVM), which rows belong to a split is
a mask, and scores and gradients of all of them are two matrix products per block.

The SVM's loss is quadratic between kinks, so with up to ``NEWTON_FEATURES`` features Newton steps are
taken instead: a pass then also sums the second derivatives of some problems, and a dozen
passes do. Both ways lead to the one minimum.

Inputs are scaled by mean and population deviation of each split's own training rows. The
scaling is put into the weights, so that the rows are stored once for all splits.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from sensorloom.operators.blocks import Block, Blocks, predicted, summed

# Pairs of steps and gradient changes that L-BFGS keeps.
MEMORY = 10
# A problem is solved when no part of its gradient, per training row, is above this.
TOLERANCE = 1e-6
# Up to so many features second derivatives are summed, so many bytes of them in one pass, and
# so many such sums are held together.
NEWTON_FEATURES = 1000
NEWTON_BYTES = 16 << 20
NEWTON_SUMS = 8
# Share of the predicted decrease that a step has to bring, and how often it may be cut.
ARMIJO, CUTS = 1e-4, 30


@dataclass(frozen=True)
class Scales:
    """Mean and 1 / deviation per split and feature (0 for constant ones), rows per split."""

    mean: np.ndarray
    inverse: np.ndarray
    rows: np.ndarray


def split_scales(blocks: Blocks) -> Scales:
    """Moments of every split's training rows, in two passes over the blocks."""

    def sums(block: Block) -> np.ndarray:
        train = (~block.held).astype(float)
        return np.hstack([train @ block.x, train.sum(1, keepdims=True)])

    first = summed(blocks.rdd, sums)
    rows = first[:, -1]
    mean = first[:, :-1] / rows[:, None]
    # Squares about a common centre, so that large means cost no digits.
    centre = mean.mean(0)

    def squares(block: Block) -> np.ndarray:
        return (~block.held).astype(float) @ (block.x - centre) ** 2

    variance = summed(blocks.rdd, squares) / rows[:, None] - (mean - centre) ** 2
    # What rounding leaves of a constant column's variance.
    noise = 1e-14 * ((mean - centre) ** 2 + mean**2)
    varies = variance > noise
    inverse = np.where(varies, 1.0 / np.sqrt(np.where(varies, variance, 1.0)), 0.0)
    return Scales(mean, inverse, rows)


class Minimiser:
    """L-BFGS with backtracking for several problems at a time, each with steps of its own."""

    def __init__(self, n_problems: int, size: int):
        self.x = np.zeros((n_problems, size))
        self.pairs: deque = deque(maxlen=MEMORY)

    def _direction(self, gradient: np.ndarray) -> np.ndarray:
        q = gradient.copy()
        alphas = []
        for s, y, rho in reversed(self.pairs):
            alpha = rho * (s * q).sum(1)
            q -= alpha[:, None] * y
            alphas.append(alpha)
        if self.pairs:
            s, y, rho = self.pairs[-1]
            yy = (y * y).sum(1)
            # 1 where the last pair of a problem was left out.
            q *= np.where(rho > 0, 1.0 / np.where(rho > 0, rho * yy, 1.0), 1.0)[:, None]
        for (s, y, rho), alpha in zip(self.pairs, reversed(alphas)):
            beta = rho * (y * q).sum(1)
            q += (alpha - beta)[:, None] * s
        return -q

    def run(
        self,
        evaluate: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]],
        tolerance: np.ndarray,
        iterations: int,
    ) -> int:
        """Minimises; ``evaluate(which, x)`` gives values and gradients of some problems."""
        n = len(self.x)
        value, gradient = evaluate(np.arange(n), self.x)
        for iteration in range(iterations):
            open_ = np.abs(gradient).max(1) > tolerance
            if not open_.any():
                return iteration
            direction = self._direction(gradient)
            slope = (direction * gradient).sum(1)
            # Where the memory points uphill, start afresh.
            uphill = slope >= 0
            direction[uphill] = -gradient[uphill]
            slope[uphill] = -(gradient[uphill] ** 2).sum(1)
            step = np.ones(n)
            if not self.pairs:
                step = np.minimum(1.0, 1.0 / np.maximum(np.abs(gradient).sum(1), 1e-300))
            new_x, new_value, new_gradient = self.x.copy(), value.copy(), gradient.copy()
            trying = np.flatnonzero(open_)
            for _ in range(CUTS):
                x = self.x[trying] + step[trying, None] * direction[trying]
                found, slopes = evaluate(trying, x)
                good = found <= value[trying] + ARMIJO * step[trying] * slope[trying]
                done = trying[good]
                new_x[done], new_value[done], new_gradient[done] = x[good], found[good], slopes[good]
                trying = trying[~good]
                if not len(trying):
                    break
                step[trying] *= 0.5
            s, y = new_x - self.x, new_gradient - gradient
            curvature = (s * y).sum(1)
            usable = curvature > 1e-12 * (y * y).sum(1)
            rho = np.where(usable, 1.0 / np.where(usable, curvature, 1.0), 0.0)
            if not usable.any():
                # No problem moves any more: as near as the arithmetic gets.
                return iteration
            self.pairs.append((s, y, rho))
            self.x, value, gradient = new_x, new_value, new_gradient
        return iterations


@dataclass(frozen=True)
class LinearModel:
    """Scores are ``x @ weights + offsets``; the greatest one is the prediction."""

    weights: np.ndarray
    offsets: np.ndarray
    seed: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.offsets

    def transform(self, table: DataFrame) -> DataFrame:
        """Adds ``prediction``, the label with the greatest score (the first of equals)."""
        return predicted(table, self)


def _plain_weights(scales: Scales, split: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple:
    """Weights and offsets for unscaled rows; ``w`` is (column, feature), ``split`` of each column."""
    plain = w * scales.inverse[split]
    return plain, b - (plain * scales.mean[split]).sum(1)


def _scaled_gradient(scales: Scales, split: np.ndarray, xr: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Gradient by the scaled weights from the sums of x * r and r per column."""
    return (xr - scales.mean[split] * r[:, None]) * scales.inverse[split]


def fit_logistic(
    blocks: Blocks, penalty: float = 1.0, iterations: int = 3000, tolerance: float = TOLERANCE
) -> list[LinearModel]:
    """Minimises ``penalty * sum(log loss) + |w|^2 / 2`` per split; intercepts are free (M7)."""
    scales = split_scales(blocks)
    n_features, n_classes = blocks.n_features, blocks.n_classes
    shape = (n_classes, n_features + 1)

    def evaluate(which: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        solved = x.reshape(len(which), *shape)
        split = np.repeat(which, n_classes)
        w, b = solved[..., :-1].reshape(-1, n_features), solved[..., -1].ravel()
        weights, offsets = _plain_weights(scales, split, w, b)

        def of_block(block: Block) -> np.ndarray:
            n = len(block.labels)
            z = (block.x @ weights.T + offsets).reshape(n, len(which), n_classes)
            z -= z.max(2, keepdims=True)
            e = np.exp(z)
            total = e.sum(2, keepdims=True)
            train = ~block.held[which].T
            own = z[np.arange(n), :, block.labels]
            losses = ((np.log(total[..., 0]) - own) * train).sum(0)
            r = e / total
            r[np.arange(n), :, block.labels] -= 1.0
            r *= train[..., None]
            r = r.reshape(n, -1)
            out = np.concatenate([r.T @ block.x, r.sum(0)[:, None]], axis=1)
            return np.concatenate([out.ravel(), losses])

        sums = summed(blocks.rdd, of_block)
        losses = sums[-len(which) :]
        found = sums[: -len(which)].reshape(-1, n_features + 1)
        gradient = np.empty((len(which), *shape))
        by_weight = _scaled_gradient(scales, split, found[:, :-1], found[:, -1])
        gradient[..., :-1] = penalty * by_weight.reshape(len(which), n_classes, -1)
        gradient[..., :-1] += solved[..., :-1]
        gradient[..., -1] = penalty * found[:, -1].reshape(len(which), -1)
        value = penalty * losses + (solved[..., :-1] ** 2).sum((1, 2)) / 2
        return value, gradient.reshape(len(which), -1)

    solver = Minimiser(len(blocks.seeds), shape[0] * shape[1])
    solver.run(evaluate, tolerance * scales.rows, iterations)
    models = []
    for s, seed in enumerate(blocks.seeds):
        solved = solver.x[s].reshape(shape)
        split = np.full(n_classes, s)
        weights, offsets = _plain_weights(scales, split, solved[:, :-1], solved[:, -1])
        models.append(LinearModel(weights.T, offsets, seed))
    return models


def fit_svm(
    blocks: Blocks, penalty: float = 1.0, iterations: int = 1000, tolerance: float = TOLERANCE
) -> list[LinearModel]:
    """Minimises ``penalty * sum(max(0, 1 - y f)^2) + (|w|^2 + b^2) / 2`` per split and class (M8).

    The intercept is one more weight, as in the usual one-against-rest solver.
    """
    scales = split_scales(blocks)
    n_features, n_classes = blocks.n_features, blocks.n_classes
    split_of = np.repeat(np.arange(len(blocks.seeds)), n_classes)
    class_of = np.tile(np.arange(n_classes), len(blocks.seeds))

    def evaluate(which: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        split, classes = split_of[which], class_of[which]
        weights, offsets = _plain_weights(scales, split, x[:, :-1], x[:, -1])

        def of_block(block: Block) -> np.ndarray:
            z = block.x @ weights.T + offsets
            y = np.where(block.labels[:, None] == classes, 1.0, -1.0)
            short = np.maximum(0.0, 1.0 - y * z)
            short *= ~block.held[split].T
            r = -2.0 * y * short
            return np.hstack([r.T @ block.x, r.sum(0)[:, None], (short**2).sum(0)[:, None]])

        sums = summed(blocks.rdd, of_block)
        gradient = np.empty_like(x)
        gradient[:, :-1] = penalty * _scaled_gradient(scales, split, sums[:, :-2], sums[:, -2])
        gradient[:, -1] = penalty * sums[:, -2]
        gradient += x
        return penalty * sums[:, -1] + (x**2).sum(1) / 2, gradient

    def curvatures(which: np.ndarray, x: np.ndarray) -> np.ndarray:
        split, classes = split_of[which], class_of[which]
        weights, offsets = _plain_weights(scales, split, x[:, :-1], x[:, -1])

        def of_block(block: Block) -> np.ndarray:
            z = block.x @ weights.T + offsets
            y = np.where(block.labels[:, None] == classes, 1.0, -1.0)
            active = (y * z < 1.0) & ~block.held[split].T
            out = np.empty((len(classes), n_features + 1, n_features + 1))
            for p in range(len(classes)):
                rows = np.hstack([block.x[active[:, p]], np.ones((active[:, p].sum(), 1))])
                out[p] = rows.T @ rows
            return out

        sums = summed(blocks.rdd, of_block, NEWTON_SUMS)
        for p, s in enumerate(split):
            # From plain rows to scaled ones.
            change = np.diag(np.append(scales.inverse[s], 1.0))
            change[:-1, -1] = -scales.inverse[s] * scales.mean[s]
            sums[p] = 2 * penalty * (change @ sums[p] @ change.T) + np.eye(n_features + 1)
        return sums

    if n_features <= NEWTON_FEATURES:
        solved = _newton(
            evaluate, curvatures, (len(split_of), n_features + 1),
            tolerance * scales.rows[split_of], iterations,
        )
    else:
        solver = Minimiser(len(split_of), n_features + 1)
        solver.run(evaluate, tolerance * scales.rows[split_of], iterations)
        solved = solver.x
    weights, offsets = _plain_weights(scales, split_of, solved[:, :-1], solved[:, -1])
    return [
        LinearModel(weights[split_of == s].T, offsets[split_of == s], seed)
        for s, seed in enumerate(blocks.seeds)
    ]


def _newton(
    evaluate: Callable, curvatures: Callable, shape: tuple[int, int],
    tolerance: np.ndarray, iterations: int,
) -> np.ndarray:
    """Minimises strictly convex functions by damped Newton steps, each with a step of its own."""
    x = np.zeros(shape)
    value, gradient = evaluate(np.arange(shape[0]), x)
    at_once = max(1, NEWTON_BYTES // (8 * shape[1] ** 2))
    for _ in range(iterations):
        open_ = np.flatnonzero(np.abs(gradient).max(1) > tolerance)
        if not len(open_):
            break
        direction = np.zeros(shape)
        for start in range(0, len(open_), at_once):
            some = open_[start : start + at_once]
            second = curvatures(some, x[some])
            direction[some] = -np.linalg.solve(second, gradient[some, :, None])[..., 0]
        slope = (direction * gradient).sum(1)
        step, trying, moved = np.ones(shape[0]), open_, False
        for _ in range(CUTS):
            new = x[trying] + step[trying, None] * direction[trying]
            found, slopes = evaluate(trying, new)
            good = found <= value[trying] + ARMIJO * step[trying] * slope[trying]
            done = trying[good]
            x[done], value[done], gradient[done] = new[good], found[good], slopes[good]
            moved = moved or len(done) > 0
            trying = trying[~good]
            if not len(trying):
                break
            step[trying] *= 0.5
        if not moved:
            # As near as the arithmetic gets.
            break
    return x
