"""Frequency fits against a plain objective and optimiser, nested clades against plain code."""

import math
import random

import numpy as np
import pytest

from virosight.operators import frequency, solvers, tree

BOUND = math.log((1 - 1e-4) / 1e-4)


def plain_objective(x, times, seen, grid, stiffness, inertia):
    """Written out step by step, by the formula alone."""
    f = [1 / (1 + math.exp(-v)) for v in x]
    total = 0.0
    for t, s in zip(times, seen, strict=True):
        k = min(max(int(np.searchsorted(grid, t, side="right")) - 1, 0), len(grid) - 2)
        a = min(max((t - grid[k]) / (grid[k + 1] - grid[k]), 0), 1)
        p = 1 / (1 + math.exp(-((1 - a) * x[k] + a * x[k + 1])))
        p = min(max(p, 1e-3), 1 - 1e-3)
        total -= math.log(p if s else 1 - p)
    for i in range(len(grid) - 1):
        held = min(max(f[i], 1e-2), 1 - 1e-2)
        change = f[i + 1] - f[i] - (inertia * (f[i] - f[i - 1]) if i else 0)
        total += 0.25 * stiffness * change**2 / ((grid[i + 1] - grid[i]) * held * (1 - held))
    return total


def pattern_search(f, x, rounds=60):
    """Coordinate steps that halve when none helps."""
    x, step, now = list(x), 1.0, f(x)
    for _ in range(rounds):
        moved = False
        for i in range(len(x)):
            for d in (step, -step):
                # Logits stay where frequencies lie within the fit's clamp.
                y = [*x[:i], min(max(x[i] + d, -BOUND), BOUND), *x[i + 1 :]]
                if (v := f(y)) < now:
                    x, now, moved = y, v, True
        if not moved:
            step /= 2
            if step < 1e-3:
                break
    return x, now


@pytest.mark.parametrize("seed", range(12))
def test_no_plain_optimiser_finds_less(seed):
    rng = np.random.default_rng(seed)
    n, grid = int(rng.integers(20, 120)), np.linspace(0, 2, 7)
    times = np.sort(rng.uniform(0, 2, n))
    level = rng.choice([0.02, 0.2, 0.5, 0.9])
    true = 1 / (1 + np.exp(-(np.log(level / (1 - level)) + rng.normal() * 2 * (times - 1))))
    seen = (rng.random(n) < true).astype(float)
    stiffness, inertia = float(rng.choice([0.5, 5, 50])), float(rng.choice([0.0, 0.5]))
    f = lambda x: plain_objective(x, times, seen, grid, stiffness, inertia)
    problem = solvers.Drift(times, seen, np.ones(n), grid, stiffness, inertia)
    start = np.full(7, np.log((seen.mean() * n + 1) / (n - seen.mean() * n + 1)))
    assert problem.value(start) == pytest.approx(f(start))
    x = problem.least(start)
    assert problem.value(x) == pytest.approx(f(x))
    _, other = pattern_search(f, start)
    assert f(x) <= other + 1e-3
    grad, _ = problem.slope(x)
    inside = np.abs(x) < np.log((1 - 1e-4) / 1e-4) - 1e-6
    eps = 1e-5
    for i in np.flatnonzero(inside):
        e = np.eye(7)[i] * eps
        assert grad[i] == pytest.approx((f(x + e) - f(x - e)) / (2 * eps), abs=2e-2)


def test_rare_features_are_smoothed_for_their_size():
    """A one per cent feature is held about as firmly, in logits, as a common one."""
    grid = np.linspace(0, 3, 13)
    rng = np.random.default_rng(0)
    times = np.sort(rng.uniform(0, 3, 20_000))
    spread = {}
    for level in (0.01, 0.5):
        f = solvers.trajectory(times, (rng.random(len(times)) < level).astype(float), grid, 5_000.0)
        spread[level] = np.std(np.log(f / (1 - f)))
        assert abs(f.mean() - level) < 0.25 * level
    assert spread[0.01] < 10 * spread[0.5] + 0.2


def test_ends_beyond_the_changes_are_constant():
    times = np.concatenate([np.linspace(0, 4, 200), np.linspace(4, 5, 60), np.linspace(5, 9, 200)])
    seen = np.concatenate([np.zeros(200), np.tile([0.0, 1.0], 30), np.ones(200)])
    grid = np.arange(0, 9.01, 0.25)
    f = solvers.trajectory(times, seen, grid, 1.0, extra=3)
    low, high = solvers.active_range(times, seen, 1 - seen, grid, 3)
    assert 0 < low < 16 and 20 < high < len(grid)
    assert np.ptp(f[: low + 1]) == 0 and np.ptp(f[high - 1 :]) == 0 and f[0] < 0.1 and f[-1] > 0.9


def plain_clades(parent, tips, start, stop, per_year, stiffness, threshold):
    """Recursion over the tree: children by size, each fitted to what the ones before it left over."""
    children = {}
    for v, p in parent.items():
        children.setdefault(p, []).append(v)
    grid = np.arange(np.floor(start * per_year), np.ceil(stop * per_year) + 1) / per_year
    out = {}
    for region in sorted({r for _, r, _ in tips}):
        own = {}
        for v, r, t in tips:
            if r == region:
                own.setdefault(v, []).append(t)
        held = {}

        def dates(v, own=own, held=held):
            if v not in held:
                held[v] = own.get(v, []) + [t for c in children.get(v, []) for t in dates(c)]
            return held[v]

        total = sum(map(len, own.values()))
        binned = lambda ts: [(math.floor(t * 100) + 0.5) / 100 for t in ts if start <= t < stop]

        def descend(v, freq, total=total, region=region, dates=dates, binned=binned):
            kids = sorted(children.get(v, []), key=lambda c: (-len(dates(c)), c))
            left, rest, done = freq.copy(), binned(dates(v)), 0
            for c in kids[:-1]:
                if len(dates(c)) < threshold or len(rest) <= threshold:
                    break
                mine, others = binned(dates(c)), list(rest)
                for t in mine:
                    others.remove(t)
                share = solvers.trajectory(np.array(mine + others), np.array([1.0] * len(mine) + [0.0] * len(others)), grid, stiffness * total / 2000.0)
                out[c, region] = left * share
                left, rest, done = left * (1 - share), others, done + 1
            for c in kids[done:]:
                out[c, region] = left / (len(kids) - done)
            for c in kids:
                descend(c, out[c, region])

        descend(0, np.ones(len(grid)))
        out |= {}
        for v in parent:
            if not dates(v):
                out.pop((v, region), None)
    return {(v, r, round(float(x), 6)): f for (v, r), fs in out.items() for x, f in zip(grid, fs, strict=True)}


@pytest.mark.parametrize("seed", range(3))
def test_nested_clades_equal_plain_code(spark, seed):
    rng = random.Random(seed)
    parent = {0: None}
    for v in range(1, 14):
        parent[v] = rng.randrange(max(0, v - 5), v)
    tips = []
    for v in range(1, 14):
        for _ in range(rng.choice([0, 3, 60])):
            tips.append((v, rng.choice(["x", "y"]), 2000 + rng.random() * 2.6))
    nodes = spark.createDataFrame([(v, p, v, 0.1) for v, p in parent.items()], "node_id int, parent_id int, child_ord int, branch_length double")
    table = spark.createDataFrame(tips, "node_id int, region string, num_date double")
    got = frequency.tree_frequencies(nodes, tree.ancestors(nodes), table, 2000.0, 2002.0, per_year=3, stiffness=200.0, threshold=15)
    got = {(r["node_id"], r["region"], round(r["pivot"], 6)): r["freq"] for r in got.collect()}
    want = plain_clades(parent, tips, 2000.0, 2002.0, 3, 200.0, 15)
    assert got.keys() == want.keys() and len(want) > 100
    assert max(abs(got[k] - max(want[k], 0)) for k in want) < 1e-4


def test_stiffness_follows_the_share_of_samples(spark):
    rng = random.Random(5)
    obs = spark.createDataFrame([("a", 2000 + rng.random() * 2, rng.random() < 0.3) for _ in range(300)], "feature string, num_date double, obs boolean")
    one = frequency.fit_trajectories(obs, ["feature"], 2000.0, 2002.0, per_year=6, stiffness=5.0, samples=3000)
    two = frequency.fit_trajectories(obs, ["feature"], 2000.0, 2002.0, per_year=6, stiffness=0.5)
    value = lambda df: [r["freq"] for r in df.orderBy("pivot").collect()]
    assert value(one) == pytest.approx(value(two), abs=1e-6)
