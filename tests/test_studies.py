"""Orders, trees, antigenic models and predictions on small cases, against brute force where there is one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from virosight.operators import antigenic, curate, explore, ordered, prediction, seasons, series, solvers, titer, trajectories, tree
from virosight.plans import lineages

TREE = "node_id int, parent_id int, child_ord int, branch_length double"


def random_tree(spark, n=60, seed=4):
    rng = np.random.default_rng(seed)
    parent = [None] + [int(rng.integers(0, i)) for i in range(1, n)]
    length = [0.0, *rng.uniform(0.01, 0.3, n - 1).tolist()]
    order = rng.permutation(n).tolist()
    kids = {}
    for i, p in enumerate(parent):
        kids.setdefault(p, []).append(i)
    for own in kids.values():
        own.sort(key=lambda i: order[i])
    return parent, kids, spark.createDataFrame([(i, p, order[i], x) for i, (p, x) in enumerate(zip(parent, length))], TREE)


def walk(kids):
    pre, post, depth, size = {}, {}, {}, {}

    def go(v, d):
        pre[v], depth[v] = len(pre), d
        size[v] = 1 + sum(go(c, d + 1) for c in kids.get(v, []))
        post[v] = len(post)
        return size[v]

    go(kids[None][0], 0)
    return pre, post, depth, size


def test_intervals_against_a_walk(spark):
    parent, kids, nodes = random_tree(spark)
    pre, post, depth, size = walk(kids)
    got = {r["node_id"]: r for r in tree.intervals(nodes).collect()}
    assert all((r["pre"], r["post"], r["depth"], r["last"], r["root"]) == (pre[v], post[v], depth[v], pre[v] + size[v] - 1, 0) for v, r in got.items()) and len(got) == 60
    counts = tree.subtree_counts(tree.intervals(nodes), nodes.select("node_id", F.lit(1).alias("v")), "v")
    assert {r["node_id"]: r["n"] for r in counts.collect()} == size


def test_cycles_are_errors(spark):
    nodes = spark.createDataFrame([(1, 2, 0, 0.1), (2, 1, 0, 0.1), (3, None, 0, 0.0)], TREE)
    for f in (tree.ancestors, tree.intervals):
        with pytest.raises(ValueError):
            f(nodes)


def test_refine_and_reroot_of_a_chain(spark):
    nodes = spark.createDataFrame([(0, None, 0, 0.0), (1, 0, 0, 0.1), (2, 0, 1, 0.2), (3, 2, 0, 0.3), (4, 3, 0, 0.4), (5, 3, 1, 0.1), (6, 5, 0, 0.1), (7, 5, 1, 0.2)], TREE)
    out = {r["node_id"]: (r["parent_id"], r["branch_length"]) for r in tree.reroot(nodes, 1).collect()}
    assert out[3] == (None, 0.001) and set(out) == {3, 4, 5, 6, 7} and out[5] == (3, 0.1)
    laid = {r["node_id"]: r for r in tree.refine(tree.reroot(nodes, 1)).collect()}
    assert laid[3]["clade"] == 4 and laid[3]["pre"] == 0 and laid[3]["yvalue"] == pytest.approx((laid[4]["yvalue"] + laid[5]["yvalue"]) / 2)
    assert sorted(laid[v]["yvalue"] for v in (4, 6, 7)) == [1, 2, 3] and laid[7]["xvalue"] == pytest.approx(0.301)


def test_order_tools_do_not_hang_on_partitions(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 40, 500) / 4
    df = spark.createDataFrame([(int(i % 3), float(x)) for i, x in enumerate(v)] + [(0, None)], "g int, v double").repartition(7)
    assert ordered.quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0]) == pytest.approx(np.quantile(v, [0.0, 0.25, 0.5, 0.9, 1.0]).tolist())
    assert ordered.quantiles(df.limit(0), "v", [0.5]) == [None]
    want = pd.DataFrame({"g": np.arange(500) % 3, "v": v})
    for r in ordered.value_counts(df, "v", ["g"]).collect():
        own = want[want.g == r["g"]].v
        assert r["n"] == (own == r["v"]).sum() and r["before"] == (own < r["v"]).sum()
    pairs = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(v, np.roll(v, 1) + v)], "g string, x double, y double")
    rank = pairs.toPandas()[["x", "y"]].rank()
    assert series.rank_correlation(pairs, "x", "y", ["g"]).first()["rho"] == pytest.approx(rank["x"].corr(rank["y"]))
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, x double").repartition(5)
    blocks = ordered.blocks_with_edges(rows, ["i"], 2, 1, 50)
    assert blocks.where("_own").count() == 500 and blocks.count() > 500
    smooth = {r["i"]: r["smooth"] for r in series.running_average(rows, "x", ["i"], 4).collect()}
    assert all(smooth[i] == pytest.approx(v[max(0, i - 2) : i + 2].mean()) for i in range(500))


def test_subsample_with_and_without_priority_against_plain_code(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), int(rng.integers(0, 4)), bool(rng.random() < 0.2)) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, m int, r int, p boolean")
    for keep in (False, True):
        want = set()
        for m in range(3):
            ranked, seen = [], {}
            for i, _, r, p in sorted(x for x in rows if x[1] == m):
                seen[p, r] = seen.get((p, r), 0) + 1
                ranked.append((not p, seen[p, r], r, i))
            ranked.sort()
            want |= {x[3] for k, x in enumerate(ranked) if k < 12 or (keep and not x[0])}
        assert {r["id"] for r in curate.round_robin_subsample(df, ["m"], "r", 12, F.col("p"), ["id"], keep).collect()} == want


def test_greedy_clusters_against_plain_code(spark):
    rng = np.random.default_rng(6)
    near = {(a, b) for a in range(40) for b in range(a) if rng.random() < 0.08}
    reps, want = [], {}
    for c in range(40):
        first = next((r for r in reps if (c, r) in near), None)
        if first is None:
            reps.append(c)
        want[c] = c if first is None else first
    columns = spark.createDataFrame([(f"c{i}", i) for i in range(40)], "col string, place int")
    pairs = spark.createDataFrame([(f"c{b}", f"c{a}") for a, b in near], "col1 string, col2 string")
    assert {r["col"]: r["cluster"] for r in antigenic.collinear_clusters(columns, pairs).collect()} == {f"c{i}": f"c{r}" for i, r in want.items()}


def test_cliques_against_plain_code(spark):
    from itertools import combinations

    rng = np.random.default_rng(8)
    edges = {(a, b) for a, b in combinations(range(12), 2) if rng.random() < 0.5}
    whole = [set(c) for k in range(2, 13) for c in combinations(range(12), k) if all(e in edges for e in combinations(c, 2))]
    want = sorted(sorted(c) for c in whole if len(c) >= 3 and not any(c < d for d in whole))
    df = spark.createDataFrame([*edges, (3, 3)], "a int, b int")
    assert sorted(r["members"] for r in antigenic.maximal_cliques(df, 3).collect()) == want


@pytest.mark.parametrize("method", sorted(antigenic.METHODS))
def test_fits_meet_first_order_conditions(spark, method):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(0, 8)), int(rng.integers(0, 5)), int(rng.integers(0, 5)), float(2 ** rng.integers(3, 8))) for i in range(150)]
    df = spark.createDataFrame(rows, "row_id int, test int, ref int, serum int, titer double").withColumn("y", F.log2("titer"))
    entries = titer.design(df, df.select("row_id", (F.abs(F.col("test") - F.col("ref")) % 4).alias("effect")))
    names, p, q = titer.collect_equations(entries, df, "y")
    model = {r["col"]: r["value"] for r in antigenic.fit_effects(entries, df, "y", method).collect()}
    x = np.array([model[n] for n in names])
    assert solvers.optimality_gap(p, q, *antigenic._penalties(names, method, 1.0, 3.0, 0.3), x) < 1e-6
    if method != "l1":
        assert min(v for k, v in model.items() if k.startswith("effect:")) >= 0
    scan = antigenic.scan_penalties(entries, df, "y", [(1.0, 3.0, 0.3), (10.0, 3.0, 0.3)], method).where("genetic = 1").collect()
    assert {r["col"]: r["value"] for r in scan} == pytest.approx(model)


def test_effects_on_branches_and_distances(spark):
    nodes = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 2), (4, 0)], "node_id int, parent_id int")
    classes = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "node_id int, effect string")
    effects = spark.createDataFrame([("x", 1.5), ("y", 0.5)], "effect string, value double")
    counts = spark.createDataFrame([(1, 1), (2, 4)], "node_id int, n int")
    got = {r["node_id"]: (r["dhi"], r["chi"]) for r in antigenic.branch_effects(nodes, classes, effects, counts).collect()}
    assert got == {0: (0.0, 0.0), 1: (0.0, 0.0), 2: (1.5, 1.5), 3: (0.5, 2.0), 4: (0.0, 0.0)}
    t = spark.createDataFrame([(1, 3, 0, "s"), (2, 3, 0, "u"), (3, 4, 0, "s")], "row_id int, test int, ref int, serum string")
    per_row = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "row_id int, effect string")
    potency = spark.createDataFrame([("s", 0.25)], "serum string, potency double")
    got = {r["test"]: r["distance"] for r in antigenic.modelled_distances(t, per_row, effects, 0, potency).collect()}
    assert got == {3: pytest.approx((2.25 + 1.5) / 2), 4: 0.25}
    pairs = spark.createDataFrame([(3, 4, "HA1", "A5T"), (3, 4, "HA1", "G6C")], "a int, b int, gene string, mutation string")
    freqs = spark.createDataFrame([("HA1", 5, "A", 0.5), ("HA1", 5, "T", 0.3), ("HA1", 6, "G", 0.9), ("HA1", 6, "C", 0.01)], "gene string, pos int, state string, freq double")
    assert [r["mutation"] for r in antigenic.frequent_mutations(pairs, freqs, 100).collect()] == ["A5T"]
    assert {tuple(r) for r in trajectories.effect_states(spark.createDataFrame([("HA1:A12T", 0.4), ("HA1:C3G", 0.01)], "mutation string, value double"), 0.1).collect()} == {("HA1", 12, "A"), ("HA1", 12, "T")}
    dated = spark.createDataFrame([("3", 2001.0), ("4", 1994.0)], "strain string, num_date double")
    assert antigenic.recent_rows(t.withColumn("test", F.col("test").cast("string")), dated, 2002.0).count() == 2


def test_quartets_of_additive_distances_have_no_gap(spark):
    x = [0.0, 1.0, 3.5, 4.0, 9.0, 11.0]
    pairs = spark.createDataFrame([(i, j, abs(x[i] - x[j])) for j in range(6) for i in range(j)], "a int, b int, d double")
    cliques = antigenic.maximal_cliques(pairs.select("a", "b"), 4)
    out = antigenic.sampled_quartets(cliques, pairs, 40).toPandas()
    assert 10 <= len(out) <= 15 and np.abs(out.gap).max() < 1e-12
    assert antigenic.sampled_quartets(cliques, pairs, 40, shuffled=True).count() == len(out)


def test_prediction_tools(spark):
    curves = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.5), ("b", 1, 0.12), ("b", 2, 0.55), ("c", 1, 0.9), ("c", 2, 0.1)], "feature string, pivot int, freq double")
    assert [tuple(r) for r in prediction.merged_features(curves).collect()] == [("a", "b")]
    masked = spark.createDataFrame([(1, "ABC"), (2, "ABD"), (0, "AAA")], "node_id int, residues string")
    up = spark.createDataFrame([(1, 2000, 0), (2, 2000, 1)], "node_id int, season int, ancestor int")
    assert {r["node_id"]: r["distance"] for r in seasons.season_distance(up, masked).collect()} == {1: 2, 2: 1}
    proteins = spark.createDataFrame([(1, "AB" + "C" * 220), (2, "XB" + "C" * 159 + "Z" + "C" * 60)], "k int, s string")
    got = {r["k"]: (r["ep"], r["ne"], r["rb"]) for r in seasons.site_distances(proteins, "k", "s", "AB" + "C" * 220, "01" + "0" * 160).collect()}
    assert got[1] == (0, 0, 0) and got[2] == (0, 2, 0 if 162 not in [s + 16 for s in (145, 155, 156, 158, 159, 189, 193)] else 1)
    s = spark.createDataFrame([(1, 5, "K"), (1, 6, "-"), (1, 7, "A")], "k int, pos int, state string")
    mapping = spark.createDataFrame([(5, 50), (6, 60), (7, 70)], "pos int, site int")
    p = spark.createDataFrame([(50, "K", 0.5), (70, "G", 0.5)], "site int, aa string, p double")
    assert seasons.aligned_tolerance(s, mapping, p, "k").first()["tolerance"] == pytest.approx(np.log(0.5) + np.log(1e-5))
    nodes = spark.createDataFrame([(1, 2000.5, 0.1)], "node_id int, num_date double, xvalue double")
    assert [explore.axis(nodes, t).first()["x"] for t in (True, False)] == [2000.5, 0.1]
    closure = tree.ancestors(spark.createDataFrame([(0, None), (1, 0), (2, 0)], "node_id int, parent_id int"))
    paths = tree.sampled_paths(closure, spark.createDataFrame([(1, 2000), (2, 2000)], "node_id int, year int"), "year").collect()
    assert len(paths) == 2 and {r["node_id"] for r in paths} in ({0, 1}, {0, 2})
    lengths = curate.sort_by_length(spark.createDataFrame([("a", "AC"), ("b", "ACG"), ("c", "AC")], "k string, s string"), "s", "k").collect()
    assert [r["k"] for r in lengths][0] == "b"
    groups = trajectories.estimate({"n": lambda d: d.groupBy("group").count()}, spark.createDataFrame([("europe",), ("china",), ("mars",)], "region string"))
    assert {r["group"]: r["count"] for r in groups["n"].collect()} == {"global": 3, "EU": 1, "AS": 1}


def test_lineages_by_identity_and_steps(spark):
    df = spark.createDataFrame([("ACGTACGTAC", None), ("ACGTACGTAA", None), ("TTTTTTTTTT", None), ("TTTT", "given")], "seq string, lineage_code string")
    got = [r["lineage_code"] for r in lineages.by_identity(df, "seq", {"one": "ACGTACGTAC", "two": "GGGGGGGGGG"}).collect()]
    assert got == ["one", "one", "other", "given"]
    raw = spark.createDataFrame([(f"A/X/{i}/2014", "2014-03-05", "asia", "japan", "cell", "ACGT" * 430) for i in range(5)], "strain string, date string, region string, country string, passage string, seq string")
    assert lineages.build(raw, lineages.LINEAGES["h1n1"], [lambda d: d.where("strain <> 'A/X/1/2014'")]).count() == 4
