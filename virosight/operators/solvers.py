"""Small numpy optimisers, run inside grouped tasks or on collected normal equations of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def quadratic(p: np.ndarray, q: np.ndarray, l1: np.ndarray, l2: np.ndarray, positive: np.ndarray, rounds: int = 5000, tol: float = 1e-10) -> np.ndarray:
    """Least of x'Px/2 + q'x + sum l1|x| + sum l2 x^2 / 2 by coordinate descent, ``positive`` coordinates at 0 or above."""
    x = np.zeros(len(q))
    g = q.astype(float).copy()
    d = np.diag(p) + l2
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(x)):
            if d[j] <= 0:
                continue
            z = d[j] * x[j] - (g[j] + l2[j] * x[j])
            new = max(z - l1[j], 0.0) / d[j] if positive[j] else np.sign(z) * max(abs(z) - l1[j], 0.0) / d[j]
            if new != x[j]:
                g += p[:, j] * (new - x[j])
                moved = max(moved, abs(new - x[j]))
                x[j] = new
        if moved < tol:
            break
    return x


def optimality_gap(p, q, l1, l2, positive, x) -> float:
    """Largest violation of the first-order conditions."""
    g = p @ x + q + l2 * x
    zero = np.where(positive, np.maximum(-(g + l1), 0), np.maximum(np.abs(g) - l1, 0))
    moved = np.abs(g + l1 * np.sign(x))
    return float(np.where(x == 0, zero, moved).max(initial=0.0))


def nelder_mead(f: Callable[[np.ndarray], float], x0: np.ndarray, step: float = 0.5, rounds: int = 400, tol: float = 1e-8) -> tuple[np.ndarray, float]:
    """Simplex minimisation with the usual reflection, expansion, contraction and shrinking."""
    n = len(x0)
    simplex = np.vstack([x0, x0 + step * np.eye(n)])
    values = np.array([f(x) for x in simplex])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        simplex, values = simplex[order], values[order]
        if values[-1] - values[0] < tol:
            break
        centre = simplex[:-1].mean(0)
        for scale in (1.0, 2.0, -0.5):
            if scale == 2.0 and not values_r < values[0]:
                continue
            trial = centre + scale * (centre - simplex[-1])
            v = f(trial)
            if scale == 1.0:
                values_r, reflected = v, trial
                if v >= values[-2]:
                    continue
                if v >= values[0]:
                    simplex[-1], values[-1] = trial, v
                    break
            elif scale == 2.0:
                simplex[-1], values[-1] = (trial, v) if v < values_r else (reflected, values_r)
                break
            elif v < values[-1]:
                simplex[-1], values[-1] = trial, v
                break
        else:
            simplex[1:] = simplex[0] + 0.5 * (simplex[1:] - simplex[0])
            values[1:] = [f(x) for x in simplex[1:]]
    k = int(values.argmin())
    return simplex[k], float(values[k])


#: Frequencies that the likelihood and the penalty's variance are held within, and that a fit's results are.
LIKELY, VARIED, CLAMP = 1e-3, 1e-2, 1e-4


class Drift:
    """Negative log likelihood of 0/1 observations under a drifting frequency, as a function of logits at grid points.

    Between grid points logits are linear.  A step's change of frequency, less
    ``inertia`` times the one before, costs ``stiffness / 4`` times its square
    over the time and the sampling variance p (1 - p) at its start, so rare
    features are held as firmly for their size as common ones.
    """

    def __init__(self, times: np.ndarray, seen: np.ndarray, weight: np.ndarray, grid: np.ndarray, stiffness: float, inertia: float):
        self.k = np.clip(np.searchsorted(grid, times, side="right") - 1, 0, len(grid) - 2)
        self.a = np.clip((times - grid[self.k]) / (grid[self.k + 1] - grid[self.k]), 0, 1)
        self.yes, self.weight, self.size = seen * weight, weight, len(grid)
        step = np.diff(np.eye(len(grid)), axis=0)
        self.steps = step.copy()
        self.steps[1:] -= inertia * step[:-1]
        self.scale = stiffness / (4 * np.diff(grid))

    def _residuals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Root costs of the steps and their derivatives by the logits."""
        f = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        held = np.clip(f[:-1], VARIED, 1 - VARIED)
        root = np.sqrt(self.scale / (held * (1 - held)))
        change = self.steps @ f
        jacobian = root[:, None] * self.steps * (f * (1 - f))
        inside = (f[:-1] > VARIED) & (f[:-1] < 1 - VARIED)
        rows = np.arange(len(root))
        jacobian[rows, rows] -= np.where(inside, root * change * (1 - 2 * f[:-1]) / 2, 0.0)
        return root * change, jacobian

    def value(self, x: np.ndarray) -> float:
        logit = (1 - self.a) * x[self.k] + self.a * x[self.k + 1]
        p = np.clip(1 / (1 + np.exp(-np.clip(logit, -30, 30))), LIKELY, 1 - LIKELY)
        r, _ = self._residuals(x)
        return float(-(self.yes * np.log(p) + (self.weight - self.yes) * np.log(1 - p)).sum() + r @ r)

    def slope(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient, and a positive curvature for Newton steps."""
        logit = (1 - self.a) * x[self.k] + self.a * x[self.k + 1]
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        open_ = (p > LIKELY) & (p < 1 - LIKELY)
        g, h = np.where(open_, self.weight * p - self.yes, 0.0), np.where(open_, self.weight * p * (1 - p), 0.0)
        r, jacobian = self._residuals(x)
        grad, hess = 2 * jacobian.T @ r, 2 * jacobian.T @ jacobian
        for i, u in ((self.k, 1 - self.a), (self.k + 1, self.a)):
            np.add.at(grad, i, u * g)
            for j, v in ((self.k, 1 - self.a), (self.k + 1, self.a)):
                np.add.at(hess, (i, j), u * v * h)
        return grad, hess

    def least(self, x: np.ndarray) -> np.ndarray:
        """Damped Newton steps from ``x``, and single logits moved by fixed steps where those are stuck, until neither lowers the value.

        The cost has kinks and valleys, where curvature alone ends too early.
        """
        x = self._newton(x)
        bound, now = np.log((1 - CLAMP) / CLAMP), self.value(x)
        for step in (2.0, 1.0, 0.5, 0.25, 0.1):
            moved = True
            while moved:
                moved = False
                for i in range(len(x)):
                    for d in (step, -step):
                        new = x.copy()
                        new[i] = np.clip(new[i] + d, -bound, bound)
                        if (value := self.value(new)) < now - 1e-6 * (1 + abs(now)):
                            x, now, moved = new, value, True
                if moved:
                    x = self._newton(x)
                    now = self.value(x)
        return x

    def _newton(self, x: np.ndarray, rounds: int = 200) -> np.ndarray:
        bound = np.log((1 - CLAMP) / CLAMP)
        now, damp = self.value(x), 1e-3
        for _ in range(rounds):
            grad, hess = self.slope(x)
            while damp < 1e9:
                new = np.clip(x - np.linalg.solve(hess + damp * np.diag(np.diag(hess) + 1e-6), grad), -bound, bound)
                value = self.value(new)
                if value < now:
                    break
                damp *= 4
            else:
                return x
            gain, x, now, damp = now - value, new, value, max(damp / 8, 1e-12)
            if gain < 1e-9 * (1 + abs(now)):
                return x
        return x


def active_range(times: np.ndarray, yes: np.ndarray, no: np.ndarray, grid: np.ndarray, extra: int) -> tuple[int, int]:
    """Grid points (first, after the last) from ``extra`` before the first change between kinds of observation to as many behind the last.

    ``times`` ascend.  With five changes or fewer the whole grid is active.
    """
    kind = np.where(no == 0, 1, np.where(yes == 0, 0, 2))
    mixed = np.flatnonzero(kind == 2)
    turns = np.flatnonzero((kind[:-1] != kind[1:]) & (kind[:-1] != 2) & (kind[1:] != 2))
    if len(turns) + 2 * len(mixed) <= 5:
        return 0, len(grid)
    places = np.concatenate([turns, mixed])
    first, last = times[places.min()], times[places.max()]
    low = max(0, int(np.searchsorted(grid, first)) - extra) if grid[0] < first < grid[-1] else 0
    high = min(len(grid), int(np.searchsorted(grid, last)) - 1 + extra) if grid[0] < last < grid[-1] else len(grid)
    return (low, high) if high - low > 2 else (0, len(grid))


def trajectory(times: np.ndarray, seen: np.ndarray, grid: np.ndarray, stiffness: float, inertia: float = 0.0, weight: np.ndarray | None = None, extra: int = 5) -> np.ndarray:
    """Most likely frequencies at the grid of 0/1 observations (each ``weight`` times) under drift: see ``Drift``.

    Only the grid around changes is fitted, with ends held constant beyond
    (``active_range``).  The fit starts on every fourth grid point and is
    refined to every second and to all.
    """
    times, seen = np.asarray(times, float), np.asarray(seen, float)
    weight = np.ones(len(times)) if weight is None else np.asarray(weight, float)
    order = np.argsort(times, kind="stable")
    times, seen, weight = times[order], seen[order], weight[order]
    if not weight.sum() > 0:
        return np.full(len(grid), 0.5)
    at, where = np.unique(times, return_inverse=True)
    yes = np.bincount(where, weights=seen * weight)
    no = np.bincount(where, weights=(1 - seen) * weight)
    low, high = active_range(at[yes + no > 0], yes[yes + no > 0], no[yes + no > 0], grid, extra)
    own = grid[low:high]
    inside = (times >= own[0]) & (times < own[-1])
    if not weight[inside].sum() > 0:
        inside = np.ones(len(times), bool)
    times, seen, weight = times[inside], seen[inside], weight[inside]
    share = np.clip(np.average(seen, weights=weight), 0.05, 0.95)
    points, x = own, np.full(len(own), np.log(share / (1 - share)))
    for every in (4, 2, 1):
        if len(grid) <= 2 * every and every > 1:
            continue
        some = own[::every] if (len(own) - 1) % every == 0 else np.append(own[::every], own[-1])
        if len(some) < 2:
            continue
        x = Drift(times, seen, weight, some, stiffness, inertia).least(np.interp(some, points, x))
        points = some
    fitted = np.clip(1 / (1 + np.exp(-x)), CLAMP, 1 - CLAMP)
    return np.interp(grid, own, fitted)
