"""Distributed fits against the local solver, and first-order conditions beyond its bound."""

import numpy as np
import pytest

from virosight.operators import antigenic, large_fit, solvers, titer


def problem(rng, rows, columns, names):
    entries, y = [], []
    true = {c: max(0.0, rng.normal()) if c.startswith("effect:") else rng.normal() / 3 for c in names}
    for r in range(rows):
        own = rng.choice(columns, size=min(columns, 6), replace=False)
        w = rng.uniform(0.3, 1, len(own))
        entries += [(r, names[k], float(v)) for k, v in zip(own, w, strict=True)]
        y.append((r, float(sum(v * true[names[k]] for k, v in zip(own, w, strict=True)) + rng.normal() / 10)))
    return entries, y


def names_of(columns):
    return [f"{('effect', 'serum', 'virus')[k % 3]}:{k}" for k in range(columns)]


@pytest.mark.parametrize("seed", range(6))
def test_projected_newton_equals_coordinate_descent(seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(80, 40))
    p, q = a.T @ a, rng.normal(size=40) * 20
    l1, l2 = np.where(rng.random(40) < 0.5, rng.uniform(0, 30, 40), 0.0), np.where(rng.random(40) < 0.5, rng.uniform(0, 3, 40), 0.0)
    positive = rng.random(40) < 0.4
    x = large_fit.solve(lambda v: p @ v, q, np.diag(p), l1, l2, positive)
    assert large_fit.first_order_gap(lambda v: p @ v, q, l1, l2, positive, x) < 1e-6
    assert np.allclose(x, solvers.quadratic(p, q, l1, l2, positive), atol=1e-6)


@pytest.mark.parametrize("method", ["nnls", "nnl2", "nnl1", "l1"])
def test_distributed_fit_equals_the_local_one(spark, monkeypatch, method):
    entries, y = problem(np.random.default_rng(1), 150, 24, names_of(24))
    e, t = spark.createDataFrame(entries, "row_id long, col string, w double"), spark.createDataFrame(y, "row_id long, y double")
    local = {r["col"]: r["value"] for r in antigenic.fit_effects(e, t, "y", method).collect()}
    monkeypatch.setattr(titer, "MAX_COLUMNS", 5)
    wide = {r["col"]: r["value"] for r in antigenic.fit_effects(e, t, "y", method).collect()}
    assert wide == pytest.approx(local, abs=1e-5) and any(wide.values())


def test_first_order_conditions_beyond_the_local_bound(spark):
    columns = 20_000
    assert columns > titer.MAX_COLUMNS
    names = names_of(columns)
    entries, y = problem(np.random.default_rng(2), 40_000, columns, names)
    e, t = spark.createDataFrame(entries, "row_id long, col string, w double"), spark.createDataFrame(y, "row_id long, y double")
    model = {r["col"]: r["value"] for r in titer.fit(e, t, "y").collect()}
    assert len(model) == columns
    # The conditions, from the rows alone.
    seat = {c: i for i, c in enumerate(names)}
    x = np.array([model[c] for c in names])
    r, c, w = (np.array(v) for v in zip(*((r, seat[c], w) for r, c, w in entries), strict=True))
    residual = np.bincount(r.astype(int), weights=w * x[c.astype(int)], minlength=len(y)) - np.array([v for _, v in y])
    times = lambda v: np.bincount(c.astype(int), weights=w * np.bincount(r.astype(int), weights=w * v[c.astype(int)], minlength=len(y))[r.astype(int)], minlength=columns)
    genetic = np.array([n.startswith("effect:") for n in names])
    ridge = np.where(genetic, 0.0, np.where([n.startswith("serum:") for n in names], 3.0, 0.3))
    q = np.bincount(c.astype(int), weights=w * (residual[r.astype(int)]), minlength=columns) - times(x)
    assert large_fit.first_order_gap(times, q, np.where(genetic, 1.0, 0.0), ridge, genetic, x) < 1e-6
