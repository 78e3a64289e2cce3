"""Sums and recurrences on trees without a closure: random trees against plain recursion, and a deep ladder."""

import math
import random
import sys

import pytest
from pyspark.sql import functions as F

from virosight.operators import contraction, tree

SHAPE = "node_id int, parent_id int, child_ord int, branch_length double"


def forest(rng, n):
    """Two roots; long chains and bushes."""
    parent = {0: None, 1: None}
    for v in range(2, n):
        parent[v] = v - 1 if rng.random() < 0.6 else rng.randrange(v)
    ids = list(range(n))
    rng.shuffle(ids)
    return {ids[v]: None if p is None else ids[p] for v, p in parent.items()}


def children_of(parent):
    out = {v: [] for v in parent}
    for v, p in parent.items():
        if p is not None:
            out[p].append(v)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_recurrences_equal_plain_recursion(spark, seed):
    sys.setrecursionlimit(10_000)
    rng = random.Random(seed)
    parent = forest(rng, 90)
    own, factor = ({v: rng.uniform(-1, 1) for v in parent} for _ in range(2))
    own[5] = None
    kids = children_of(parent)

    def up(v):
        return (own[v] or 0.0) + sum(factor[c] * up(c) for c in kids[v])

    def down(v):
        return (own[v] or 0.0) + (factor[v] * down(parent[v]) if parent[v] is not None else 0.0)

    nodes = spark.createDataFrame([(v, p, own[v], factor[v]) for v, p in parent.items()], "node_id int, parent_id int, own double, factor double")
    got = {r["node_id"]: r["x"] for r in contraction.linear_up(nodes, "own", "factor", "x").collect()}
    assert got.keys() == parent.keys() and all(math.isclose(got[v], up(v), abs_tol=1e-9) for v in parent)
    got = {r["node_id"]: r["x"] for r in contraction.linear_down(nodes, "own", "factor", "x").collect()}
    assert got.keys() == parent.keys() and all(math.isclose(got[v], down(v), abs_tol=1e-9) for v in parent)
    marks = {v for v in parent if rng.random() < 0.2}

    def near(v):
        while v is not None and v not in marks:
            v = parent[v]
        return v

    got = {r["node_id"]: r["near"] for r in contraction.nearest_marked(nodes, spark.createDataFrame([(v,) for v in marks], "node_id int")).collect()}
    assert got == {v: near(v) for v in parent}


def test_sums_equal_plain_recursion(spark):
    rng = random.Random(3)
    parent = forest(rng, 80)
    kids = children_of(parent)
    length = {v: round(rng.uniform(0, 1), 3) if v % 9 else None for v in parent}
    below = lambda v: (length[v] or 0.0) + sum(below(c) for c in kids[v])
    above = lambda v: (length[v] or 0.0) + (above(parent[v]) if parent[v] is not None else 0.0)
    nodes = spark.createDataFrame([(v, p, v, length[v]) for v, p in parent.items()], SHAPE)
    spans = tree.intervals(nodes)
    got = {r["node_id"]: r["below"] for r in tree.subtree_sums(spans, nodes, "branch_length", "below").collect()}
    assert got == pytest.approx({v: below(v) for v in parent}, abs=1e-12)
    got = {r["node_id"]: r["xvalue"] for r in tree.root_distance(nodes).collect()}
    assert got == pytest.approx({v: above(v) for v in parent}, abs=1e-12)
    tips = [v for v in parent if not kids[v]]
    value = {v: rng.random() for v in tips}
    mean = lambda v: value[v] if v in value else sum(map(mean, kids[v])) / len(kids[v])
    got = {r["node_id"]: r["y"] for r in tree.mean_of_children(nodes, spark.createDataFrame(list(value.items()), "node_id int, y double"), "y").collect()}
    assert got == pytest.approx({v: mean(v) for v in parent}, abs=1e-9)


def test_a_ladder_of_twenty_thousand(spark):
    """Depth is no matter: rows stay in proportion to the nodes."""
    n = 20_000
    nodes = spark.range(n).select(F.col("id").cast("int").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).cast("int").alias("parent_id"), F.lit(0).alias("child_ord"), F.lit(0.5).alias("branch_length"), F.lit(1.0).alias("own"), F.lit(1.0).alias("factor"))
    last = lambda df, c: df.where(F.col("node_id") == n - 1).first()[c]
    assert last(tree.root_distance(nodes), "xvalue") == n / 2
    assert last(contraction.linear_down(nodes, "own", "factor", "x"), "x") == n
    assert contraction.linear_up(nodes, "own", "factor", "x").where("node_id = 0").first()["x"] == n


def test_cycles_are_errors(spark):
    nodes = spark.createDataFrame([(1, 2, 1.0, 1.0), (2, 3, 1.0, 1.0), (3, 1, 1.0, 1.0), (4, 3, 1.0, 1.0)], "node_id int, parent_id int, own double, factor double")
    for run in (contraction.linear_down, contraction.linear_up):
        with pytest.raises(ValueError, match="own ancestor"):
            run(nodes, "own", "factor", "x")
    with pytest.raises(ValueError, match="own ancestor"):
        contraction.nearest_marked(nodes, nodes.where("node_id > 9"))
