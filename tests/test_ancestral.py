"""Ancestral states by contraction: the same as with the whole tree in one task, on trees of many shapes."""

import random

import pytest
from pyspark.sql import functions as F

from virosight.operators import ancestral


def shapes(rng):
    ladder = {v: None if v == 0 else v - 1 for v in range(40)}
    star = {v: None if v == 0 else 0 for v in range(900)}
    mixed = {v: None if v < 2 else v - 1 if rng.random() < 0.5 else rng.randrange(v) for v in range(80)}
    return {"ladder": ladder, "star": star, "mixed": mixed}


@pytest.mark.parametrize("shape", ["ladder", "star", "mixed"])
def test_contraction_gives_the_states_of_one_task(spark, shape):
    rng = random.Random(shape)
    parent = shapes(rng)[shape]
    ids = list(range(len(parent)))
    rng.shuffle(ids)
    length = {v: None if rng.random() < 0.05 else 0.0 if rng.random() < 0.1 else rng.expovariate(4) for v in parent}
    nodes = spark.createDataFrame([(ids[v], None if p is None else ids[p], length[v]) for v, p in parent.items()], "node_id int, parent_id int, branch_length double")
    inner = set(parent.values())
    rows = [(ids[v], pos, rng.choice("ACGTacgN-") if pos != 12 else "N") for v in parent if v not in inner or v % 7 == 0 for pos in (3, 5, 9, 12) if rng.random() < 0.9]
    rows += [(i, pos + 10, s) for i, pos, s in rows if pos == 5]  # place 15 repeats place 5
    rows += [(10**6, 5, "A"), (rows[0][0], 5, None), (rows[0][0], 3, "AC"), (rows[0][0], 3, "G"), (rows[0][0], 3, "T")]
    tips = spark.createDataFrame(rows, "node_id int, pos int, state string")
    want = {(r["node_id"], r["pos"]): r["state"] for r in ancestral.reconstruct(nodes, tips).collect()}
    got = ancestral.reconstruct_contracted(nodes, tips).collect()
    assert len(got) == len(want) == len(parent) * 5
    wrong = [r for r in got if want[r["node_id"], r["pos"]] != r["state"]]
    assert not wrong
    assert len({r["state"] for r in got}) == 4


def test_large_trees_are_contracted(spark, monkeypatch):
    nodes = spark.createDataFrame([(0, None, 0.0), (1, 0, 0.1), (2, 0, 0.1), (3, 9, 0.1)], "node_id int, parent_id int, branch_length double")
    tips = spark.createDataFrame([(1, 1, "G"), (2, 1, "G"), (3, 1, "T")], "node_id int, pos int, state string")
    monkeypatch.setattr(ancestral, "MAX_NODES", 3)
    out = ancestral.reconstruct(nodes, tips)
    assert {(r["node_id"], r["pos"]): r["state"] for r in out.collect()} == {(0, 1): "G", (1, 1): "G", (2, 1): "G", (3, 1): "T"}
    assert ancestral.reconstruct(nodes, tips.limit(0)).isEmpty() and ancestral.reconstruct(nodes.withColumn("node_id", F.col("node_id") + 10).limit(0), tips).isEmpty()


def test_a_cycle_is_an_error(spark):
    nodes = spark.createDataFrame([(0, None, 0.0), (1, 2, 0.1), (2, 1, 0.1)], "node_id int, parent_id int, branch_length double")
    with pytest.raises(ValueError, match="its own ancestor"):
        ancestral.reconstruct_contracted(nodes, spark.createDataFrame([(1, 1, "G")], "node_id int, pos int, state string"))
