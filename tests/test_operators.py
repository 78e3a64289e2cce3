import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from virosight.operators import curate, frequency, series, sites, solvers, titer, tree


def test_keep_first_is_ordered_and_idempotent(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z"), (None, 1, "n")], "k string, o int, v string")
    once = curate.keep_first(df, ["k"], ["o"])
    assert sorted((r["k"] or "", r["v"]) for r in once.collect()) == [("", "n"), ("a", "y"), ("b", "z")]
    assert curate.keep_first(once, ["k"], ["o"]).count() == 3


def test_subsample_holds_its_limit(spark):
    df = spark.range(200).select("id", (F.col("id") % 4).alias("m"), (F.col("id") % 5).alias("r"), (F.col("id") % 17 == 0).alias("p"))
    out = curate.round_robin_subsample(df, ["m"], "r", 10, F.col("p"), ["id"])
    assert {r["count"] for r in out.groupBy("m").count().collect()} == {10}
    kept = curate.round_robin_subsample(df, ["m"], "r", 1, F.col("p"), ["id"], keep_priority=True)
    assert kept.where("p").count() == 12


def test_as_of_takes_last_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "g string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 7, 70)], "g string, t int, v int")
    assert {(r["g"], r["t"]): r["v"] for r in series.as_of(left, right, ["g"], "t", ["v"]).collect()} == {("a", 5): 50, ("a", 1): None, ("b", 9): None}


def test_histogram_closes_last_bin(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 1.1)], "v double")
    assert {r["bin"]: r["n"] for r in series.histogram(df, "v", 0.0, 1.0, 2).collect()} == {0: 1, 1: 2}


def test_bootstrap_is_near_the_share(spark):
    df = spark.range(2000).select("id", F.lit("g").alias("g"), (F.col("id") % 4 == 0).alias("s"))
    r = series.bootstrap_share(df, F.col("s"), ["id"], ["g"], draws=20).first()
    assert abs(r["mean"] - 0.25) < 0.02 and 0 < r["deviation"] < 0.05


def test_bootstrap_equals_plain_resamples(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 5 == 0 else f"g{rng.integers(4)}", None if i % 11 == 0 else bool(rng.random() < 0.4)) for i in range(300)] + [(1000, "lone", True)]
    df = spark.createDataFrame(rows, "id int, g string, s boolean")
    hashes = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("id", F.lit(3)).alias("h")).collect()}
    monkeypatch.setattr(series, "HELD", 100)  # counters are handed on all the time
    got = {r["g"]: (r["mean"], r["deviation"]) for r in series.bootstrap_share(df, F.col("s"), ["id"], ["g"], draws=30, seed=3).collect()}
    assert len(got) == 6
    for g, (mean, deviation) in got.items():
        own = [(hashes[i], bool(s)) for i, h, s in rows if h == g]
        copies = series.poisson_copies(np.array([h for h, _ in own]), np.arange(30))
        hits = np.array([s for _, s in own]) @ copies
        share = [h / n for h, n in zip(hits, copies.sum(0)) if n]
        assert math.isclose(mean, np.mean(share)) and math.isclose(deviation, np.std(share), abs_tol=1e-12)
    n = series.poisson_copies(np.arange(20_000) * 7919, np.arange(5))
    assert abs(n.mean() - 0.5) < 0.01 and abs(n.var() - 0.5) < 0.02
    assert series.bootstrap_share(df, F.col("s"), ["id"], []).count() == 1 and series.bootstrap_share(df.limit(0), F.col("s"), ["id"], ["g"]).isEmpty()


@pytest.mark.parametrize("penalty", [0.0, 0.3, 0.5, 0.9])
def test_closest_reference_equals_plain_counts(spark, penalty):
    rng = np.random.default_rng(int(penalty * 10))
    # Some places are common to nearly all, some rows are copies, and some are null.
    some = lambda n: {(int(p), "ACGT"[rng.integers(3)] if p > 6 else "A") for p in range(1, 25) if rng.random() < (0.9 if p <= 6 else n)}
    q, r = ({i: some(w) for i in range(k)} for k, w in ((60, 0.3), (25, 0.2)))
    for i in range(60, 80):
        q[i] = q[i % 7]
    r[30], r[31], r[32] = r[3], r[4], set()
    long = lambda d: spark.createDataFrame([(i, *e) for i, s in d.items() for e in s] + [(0, None, "A"), (0, *min(d[0]))], "k int, pos int, state string")
    want = {}
    for i, s in q.items():
        scores = [(-round(len(s & t) - penalty * len(t), 9), j) for j, t in r.items() if round(len(s & t) - penalty * len(t), 9) > 0 and s & t]
        if scores:
            want[i] = min(scores)
    got = {x["k"]: (-x["score"], x["ref"]) for x in sites.closest_reference(long(q), long(r).withColumnRenamed("k", "ref"), "k", "ref", penalty).collect()}
    assert got.keys() == want.keys() and all(got[i][1] == want[i][1] and math.isclose(got[i][0], want[i][0]) for i in want) and (penalty > 0.6 or len(want) > 70)


def test_frequencies_sum_to_one_and_entropy_is_bounded(spark):
    rows = [(i, p, "ACGT"[(i * p) % 4]) for i in range(12) for p in (1, 2, 3)]
    f = sites.site_frequencies(spark.createDataFrame(rows, "k int, pos int, state string"))
    assert all(abs(r["t"] - 1) < 1e-12 for r in f.groupBy("pos").agg(F.sum("freq").alias("t")).collect())
    assert all(-1e-12 <= r["entropy"] <= np.log(4) + 1e-12 for r in sites.entropy(f).collect())


def random_tree(n=40, seed=3):
    rng = np.random.default_rng(seed)
    parent = [None] + [int(rng.integers(0, i)) for i in range(1, n)]
    return parent, [0.0, *rng.uniform(0.01, 0.3, n - 1).tolist()]


def test_tree_operators_against_brute_force(spark):
    parent, length = random_tree()
    nodes = spark.createDataFrame([(i, p, i, x) for i, (p, x) in enumerate(zip(parent, length))], "node_id int, parent_id int, child_ord int, branch_length double")
    paths = {}
    for i in range(len(parent)):
        j, d, paths[i] = i, 0.0, {}
        while j is not None:
            paths[i][j] = d
            d, j = d + length[j], parent[j]
    got = {(r["node"], r["ancestor"]): r["distance"] for r in tree.ancestors(nodes, length="branch_length").collect()}
    assert set(got) == {(i, a) for i in paths for a in paths[i]}
    assert all(abs(got[i, a] - paths[i][a]) < 1e-12 for i in paths for a in paths[i])

    tau, lbi = 0.2, {}
    for n in paths:
        lbi[n] = 0.0
        for b in range(1, len(parent)):
            d = min(paths[n][a] + paths[b][a] for a in paths[n] if a in paths[b])
            near = d if b in paths[n] and paths[n][b] == d else d - length[b] if b not in paths[n] else d
            lbi[n] += tau * (1 - np.exp(-length[b] / tau)) * np.exp(-near / tau)
    out = {r["node_id"]: r["lbi"] for r in tree.branching_index(nodes, nodes.select("node_id"), tau).collect()}
    assert all(abs(out[n] - lbi[n]) < 1e-9 for n in lbi)


def test_deep_chain_takes_few_rounds(spark):
    n = 150
    nodes = spark.range(n).select(F.col("id").cast("int").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).cast("int").alias("parent_id"))
    assert tree.ancestors(nodes).count() == n * (n + 1) // 2


def test_reroot_and_collapse(spark):
    nodes = spark.createDataFrame([(0, None, 0, 0.0), (1, 0, 0, 0.1), (2, 0, 1, 0.2), (3, 2, 0, 0.3), (4, 2, 1, 0.0)], "node_id int, parent_id int, child_ord int, branch_length double")
    out = {r["node_id"]: (r["parent_id"], r["branch_length"]) for r in tree.reroot(nodes, 1).collect()}
    assert out == {2: (None, 0.001), 3: (2, 0.3), 4: (2, 0.0)}
    kept = tree.collapse(nodes, F.col("node_id") == 2)
    assert {r["node_id"]: r["parent_id"] for r in kept.collect()} == {0: None, 1: 0, 3: 0, 4: 0}


def test_quadratic_meets_optimality():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(60, 12))
    p, q = a.T @ a, -a.T @ rng.normal(size=60)
    for positive in (True, False):
        args = (p, q, np.full(12, 0.5), np.linspace(0, 1, 12), np.full(12, positive))
        x = solvers.quadratic(*args)
        assert solvers.optimality_gap(*args, x) < 1e-6


def test_nelder_mead_finds_the_minimum():
    x, v = solvers.nelder_mead(lambda x: float(((x - [1.0, -2.0]) ** 2).sum()), np.zeros(2))
    assert np.allclose(x, [1, -2], atol=1e-3) and v < 1e-6


def test_trajectory_recovers_a_sweep(spark):
    rng = np.random.default_rng(1)
    t = rng.uniform(2000, 2003, 3000)
    f = 1 / (1 + np.exp(-3 * (t - 2001.5)))
    obs = spark.createDataFrame([("m", float(a), bool(b)) for a, b in zip(t, rng.random(3000) < f)], "feature string, num_date double, obs boolean")
    out = frequency.fit_trajectories(obs, ["feature"], 2000.0, 2003.0, per_year=12, stiffness=2.0).toPandas()
    truth = 1 / (1 + np.exp(-3 * (out["pivot"] - 2001.5)))
    assert np.abs(out.freq - truth).max() < 0.12


def test_trajectory_of_a_rare_feature_on_many_rows(spark):
    bins = spark.range(300).selectExpr("'m' as feature", "2000D + (id + 0.5D) / 100D as _t", "70 as _yes", "7000 as _n")
    out = frequency.fit_bins(bins, ["feature"], 2000.0, 2003.0).toPandas()
    assert np.abs(out.freq - 0.01).max() < 1e-4


def test_weights_equal_repeated_observations():
    rng = np.random.default_rng(7)
    t, seen, n = rng.uniform(2000, 2003, 200), rng.integers(0, 2, 200).astype(float), rng.integers(0, 9, 200)
    grid = np.arange(2000, 2003.01, 1 / 12)
    once = solvers.trajectory(t, seen, grid, 5.0, weight=n)
    assert np.allclose(once, solvers.trajectory(np.repeat(t, n), np.repeat(seen, n), grid, 5.0), atol=1e-6)


def test_titer_fit_recovers_effects(spark):
    rows, y = [], []
    rng = np.random.default_rng(2)
    for i in range(300):
        test, ref = int(rng.integers(0, 15)), int(rng.integers(0, 6))
        rows.append((i, f"v{test}", f"v{ref}", f"s{ref}", abs(test - ref) % 4))
    df = spark.createDataFrame(rows, "row_id int, test string, ref string, serum string, effect int")
    y = df.withColumn("y", F.when(F.col("effect") == 3, 2.0).otherwise(0.0))
    entries = titer.design(df, df.select("row_id", "effect"), kc=0.0).withColumn("w", F.lit(1.0))
    model = {r["col"]: r["value"] for r in titer.fit(entries, y, "y", l1=0.1).collect()}
    assert model["effect:3"] > 1.2 and min(v for k, v in model.items() if k.startswith("effect")) >= 0


def test_plans_stay_in_the_jvm(spark):
    from virosight.plans.catalogue import QUERIES

    plan = QUERIES["site_frequencies"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ReadSchema: struct<text:string>" in plan


def test_ancestral_marginals_against_enumeration(spark):
    from itertools import product

    from virosight.operators import ancestral

    parent, length = [-1, 0, 0, 1, 1, 2, 2], [0.0, 0.2, 0.1, 0.3, 0.4, 0.1, 0.5]
    tips = {3: "A", 4: "C", 5: "C", 6: None}
    p = ancestral.transition(np.array(length))
    total = np.zeros((7, 4))
    for states in product(range(4), repeat=7):
        if all(t is None or "ACGT"[states[i]] == t for i, t in tips.items()):
            w = 0.25 * np.prod([p[i][states[parent[i]], states[i]] for i in range(1, 7)])
            for i, s in enumerate(states):
                total[i, s] += w
    total /= total.sum(1, keepdims=True)
    seen = np.ones((7, 1, 4))
    for i, t in tips.items():
        if t:
            seen[i, 0] = [c == t for c in "ACGT"]
    got = ancestral.marginals(np.array(parent), np.array(length), seen)[:, 0]
    assert np.allclose(got, total, atol=1e-9)
    nodes = spark.createDataFrame([(i, None if q < 0 else q, x) for i, (q, x) in enumerate(zip(parent, length))], "node_id int, parent_id int, branch_length double")
    sites_ = spark.createDataFrame([(i, 70, t) for i, t in tips.items() if t], "node_id int, pos int, state string")
    out = {r["node_id"]: r["state"] for r in ancestral.reconstruct(nodes, sites_).collect()}
    assert out == {i: "ACGT"[total[i].argmax()] for i in range(7)}


def test_season_ancestor_and_parent_mutations(spark):
    from virosight.operators import seasons

    nodes = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 1), (4, 0)], "node_id int, parent_id int")
    closure = tree.ancestors(nodes)
    tips = spark.createDataFrame([(2, 2000), (3, 2001), (4, 2001)], "node_id int, season int")
    freq = seasons.season_frequencies(closure, tips)
    got = {(r["node_id"], r["season"]): r["ancestor"] for r in seasons.season_ancestor(closure, freq, nodes).collect()}
    assert got[3, 2001] == 1 and got[4, 2001] == 0 and got[2, 2000] == 0
    s = spark.createDataFrame([(1, "HA1", 5, "K"), (0, "HA1", 5, "N"), (1, "HA1", 6, "A"), (0, "HA1", 6, "A")], "node_id int, gene string, pos int, state string")
    pairs = spark.createDataFrame([(2, 4)], "a int, b int")
    assert [r["mutation"] for r in seasons.parent_mutations(nodes, s, pairs, "a", "b").collect()] == ["K5N"]


def test_tree_frequencies_add_up(spark):
    rng = np.random.default_rng(5)
    nodes = [(0, None), (1, 0), (2, 0)]
    tips = []
    for i in range(300):
        t = rng.uniform(2000, 2002)
        parent = 1 if rng.random() < (t - 2000) / 2 else 2
        nodes.append((10 + i, parent))
        tips.append((10 + i, "all", float(t)))
    nodes = spark.createDataFrame(nodes, "node_id int, parent_id int")
    freq = frequency.tree_frequencies(nodes, tree.ancestors(nodes), spark.createDataFrame(tips, "node_id int, region string, num_date double"), 2000.0, 2002.0, per_year=4, stiffness=1.0)
    f = freq.where("node_id in (1, 2)").toPandas().pivot(index="pivot", columns="node_id", values="freq")
    assert np.allclose(f[1] + f[2], 1) and f[1].iloc[-2] > 0.7 > 0.3 > f[1].iloc[1]
    below = freq.where("node_id >= 10").groupBy("pivot").agg(F.sum("freq").alias("t")).toPandas()
    assert np.allclose(below.t, 1, atol=1e-6)
