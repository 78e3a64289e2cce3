"""Ancestral states by marginal likelihood under a uniform four-state model.

Places are independent, so they are dealt out in blocks; a task gets the tip
states of its block and the tree, if that has a checked size.  Larger trees
stay node tables: messages are passed by tree contraction
(``reconstruct_contracted``), about log(n) rounds of joins for a ladder, a
bush and a star alike, and neither the driver nor a task holds the tree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from virosight.session import dropped, saved, scratch

STATES = "ACGT"
#: Nodes of one tree that go to every task, places in a block and node states of a block at most, and the floor of messages.
MAX_NODES, BLOCK, BLOCK_STATES, TINY = 500_000, 64, 1_000_000, 1e-30
#: Probabilities this near to the largest one are ties, whatever the order of the sums.
NEAR = 1e-9


def transition(t: np.ndarray) -> np.ndarray:
    """Probabilities of states after time t: rate 1, equal to all other states."""
    stay = 0.25 + 0.75 * np.exp(-4 * (t + 1e-7) / 3)
    out = np.empty((len(t), 4, 4))
    out[:] = ((1 - stay) / 3)[:, None, None]
    out[:, range(4), range(4)] = stay[:, None]
    return out


def marginals(parent: np.ndarray, length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Normalised state probabilities (nodes x places x 4); parents stand before their children, ``seen`` are the tips' own."""
    n = len(parent)
    p = transition(length)
    # Products over many children would leave the range of doubles, so they are sums of logarithms.
    up, message = np.log(np.maximum(seen, TINY)), np.empty_like(seen)
    for i in range(n - 1, -1, -1):
        up[i] = np.maximum(np.exp(up[i] - up[i].max(1, keepdims=True)), TINY)
        message[i] = up[i] @ p[i]
        if parent[i] >= 0:
            up[parent[i]] += np.log(message[i])
    down = np.full_like(seen, 0.25)
    for i in range(n):
        if parent[i] >= 0:
            above = np.maximum(up[parent[i]] * down[parent[i]] / np.maximum(message[i], TINY), TINY)
            down[i] = (above / above.sum(1, keepdims=True)) @ p[i]
    full = up * down
    return full / full.sum(2, keepdims=True)


def _at(f, *sizes: int) -> Column:
    """Array of f(i) or f(i, j) over the four states."""
    return F.array(*(f(*(k // 4 ** (len(sizes) - 1 - d) % 4 for d in range(len(sizes)))) for k in range(4 ** len(sizes))))


def _applied(m: str, x: str) -> Column:
    """A 4 x 4 matrix (16 numbers by row) times a vector."""
    return _at(lambda i: sum((F.col(m)[4 * i + k] * F.col(x)[k] for k in range(1, 4)), F.col(m)[4 * i] * F.col(x)[0]), 4)


def _product(a: str, b: str) -> Column:
    return _at(lambda i, j: sum((F.col(a)[4 * i + k] * F.col(b)[4 * k + j] for k in range(1, 4)), F.col(a)[4 * i] * F.col(b)[j]), 4, 4)


def _scaled(df: DataFrame, name: str) -> DataFrame:
    """The largest number of an array column becomes 1: only proportions matter."""
    return df.withColumn(name, F.transform(name, lambda x: x / F.array_max(name)))


def _proportions(b: str) -> Column:
    """Likelihoods from their logarithms, the largest 1."""
    return F.transform(b, lambda x: F.greatest(F.exp(x - F.array_max(b)), F.lit(TINY)))


def _chains(open_: DataFrame) -> DataFrame:
    """``v, pat, to, a, p, m`` of open nodes with one open child: likelihoods = a times those of ``to``, which has not just one; parent and edge of the node."""
    child = open_.where("p is not null").select(F.col("p").alias("v"), "pat", F.col("v").alias("to"), F.col("m").alias("edge"), (F.col("k") == 1).alias("more"))
    unary = open_.where("k = 1").select("v", "pat", "p", "m", _proportions("b").alias("own"))
    step = unary.join(child, ["v", "pat"]).withColumn("a", _at(lambda i, j: F.col("own")[i] * F.col("edge")[4 * i + j], 4, 4))
    jump = saved(_scaled(step, "a").select("v", "pat", "to", "a", "p", "m", "more"))
    rounds = max(1, jump.select("v").distinct().count()).bit_length() + 1
    while not jump.where("more").isEmpty():
        if not (rounds := rounds - 1):
            raise ValueError("a node is its own ancestor")
        ahead = jump.select(F.col("v").alias("to"), "pat", F.col("to").alias("next"), F.col("a").alias("a2"), F.col("more").alias("more2"))
        joined = jump.withColumnRenamed("more", "open").join(ahead, ["to", "pat"], "left")
        moved = joined.withColumn("a", F.when(F.col("next").isNotNull(), _product("a", "a2")).otherwise(F.col("a"))).withColumn("to", F.coalesce("next", "to"))
        before = jump
        jump = saved(_scaled(moved, "a").select("v", "pat", "to", "a", "p", "m", F.coalesce("more2", F.lit(False)).alias("more")))
        dropped(before)
    return jump


def _upwards(rows: DataFrame) -> DataFrame:
    """``v, pat, x``: likelihoods of what is seen at and below each node.

    ``rows``: v, p, pat, b (logarithms of the node's own likelihoods) and m
    (transitions from the parent).  Leaves hand their messages to their
    parents as sums of logarithms, combined before the shuffle; chains of
    nodes with one open child become one matrix.
    """
    children = rows.where("p is not null").groupBy(F.col("p").alias("v"), "pat").agg(F.count("*").alias("k"))
    open_ = saved(rows.join(children, ["v", "pat"], "left").select("v", "p", "pat", "b", "m", F.coalesce("k", F.lit(0)).alias("k")))
    values, folded = [], []
    count = open_.count()
    while count:
        done = saved(open_.where("k = 0").select("v", "pat", _proportions("b").alias("x"), "p", "m"))
        values.append(done.select("v", "pat", "x"))
        sent = done.where("p is not null").select(F.col("p").alias("v"), "pat", _applied("m", "x").alias("y"))
        sums = sent.groupBy("v", "pat").agg(F.count("*").alias("_k"), _at(lambda i: F.sum(F.log(F.col("y")[i])), 4).alias("_b"))
        added = F.when(F.col("_k").isNull(), F.col("b")).otherwise(_at(lambda i: F.col("b")[i] + F.col("_b")[i], 4))
        rest = saved(open_.where("k > 0").join(sums, ["v", "pat"], "left").select("v", "p", "pat", added.alias("b"), "m", (F.col("k") - F.coalesce("_k", F.lit(0))).alias("k")))
        jump = _chains(rest)
        folded.append(jump)
        # The node below a chain takes the parent of the chain's top, over the product of the steps.
        tops = jump.join(jump.select(F.col("v").alias("p"), "pat"), ["p", "pat"], "left_anti")
        heirs = _scaled(tops.select(F.col("to").alias("v"), "pat", F.col("p").alias("_p"), _product("m", "a").alias("_m")), "_m").withColumn("_moved", F.lit(True))
        before = open_
        open_ = saved(
            rest.where("k <> 1").join(heirs, ["v", "pat"], "left")
            .select("v", F.when(F.col("_moved"), F.col("_p")).otherwise(F.col("p")).alias("p"), "pat", "b", F.coalesce("_m", "m").alias("m"), "k")
        )
        for old in (before, rest):
            dropped(old)
        last, count = count, open_.count()
        if count >= last:
            raise ValueError("a node is its own ancestor")
    if not values:
        return rows.select("v", "pat", _proportions("b").alias("x"))
    result = values[0]
    for more in values[1:]:
        result = result.unionByName(more)
    result = saved(result)
    for jump in reversed(folded):
        if not jump.isEmpty():
            met = jump.select("v", "pat", "to", "a").join(result.select(F.col("v").alias("to"), "pat", "x"), ["to", "pat"])
            before, result = result, saved(result.unionByName(_scaled(met.select("v", "pat", _applied("a", "x").alias("x")), "x")))
            dropped(before)
    return result


def _downwards(rows: DataFrame, up: DataFrame) -> DataFrame:
    """``v, pat, g``: likelihoods at each node of all that is seen elsewhere; the steps from the parents are composed by doubling."""
    above = up.select(F.col("v").alias("p"), "pat", F.col("x").alias("xp"))
    own = rows.select("v", "p", "pat", "m").join(up, ["v", "pat"]).withColumn("y", _applied("m", "x")).join(above, ["p", "pat"], "left")
    # From the parent's outside to the node's: the parent's likelihoods without the node's message, then the branch.
    known = own.withColumn("a", F.when(F.col("p").isNotNull(), _at(lambda i, j: F.col("m")[4 * j + i] * F.col("xp")[j] / F.col("y")[j], 4, 4)))
    step = saved(_scaled(known, "a").select("v", "pat", F.col("p").alias("to"), "a"))
    rounds = max(1, step.select("v").distinct().count()).bit_length() + 1
    while not step.where("to is not null").isEmpty():
        if not (rounds := rounds - 1):
            raise ValueError("a node is its own ancestor")
        ahead = step.select(F.col("v").alias("to"), "pat", F.col("to").alias("next"), F.col("a").alias("a2"))
        joined = step.join(ahead, ["to", "pat"], "left").withColumn("a", F.when(F.col("a2").isNotNull(), _product("a", "a2")).otherwise(F.col("a")))
        before = step
        step = saved(_scaled(joined, "a").select("v", "pat", F.col("next").alias("to"), "a"))
        dropped(before)
    # A root's outside is the same for all states.
    total = _at(lambda i: sum((F.col("a")[4 * i + j] for j in range(1, 4)), F.col("a")[4 * i]), 4)
    return step.select("v", "pat", F.when(F.col("a").isNull(), F.array(*[F.lit(1.0)] * 4)).otherwise(total).alias("g"))


def reconstruct_contracted(nodes: DataFrame, sites: DataFrame) -> DataFrame:
    """As ``reconstruct``, for trees of any size: joins and aggregates of node tables, about log(n) rounds.

    Places whose tips show the same states are worked on once (states are
    summed to two 64-bit hashes a place).  Several states of one tip and place
    mean any of them.  Parents that are no nodes count as none; a cycle is an
    error.
    """
    with scratch():
        ids = nodes.select(F.col("node_id").alias("p"), F.lit(True).alias("_in"))
        length = F.coalesce("branch_length", F.lit(0.0)).cast("double")
        tree = saved(nodes.select(F.col("node_id").alias("v"), F.col("parent_id").alias("p"), length.alias("t")).join(ids, "p", "left").select("v", F.when(F.col("_in"), F.col("p")).alias("p"), "t"))
        seat = F.instr(F.lit(STATES), F.upper("state"))
        tips = sites.select(F.col("node_id").alias("v"), F.col("pos").cast("int").alias("pos"), F.when(F.length("state") == 1, seat).otherwise(0).alias("s"))
        masks = tips.where("s > 0").join(tree.select("v"), "v", "left_semi").groupBy("v", "pos").agg(F.bit_or(F.expr("shiftleft(1, s - 1)")).alias("mask"))
        masks = saved(masks)
        hashed = masks.groupBy("pos").agg(F.struct(*(F.bit_xor(F.xxhash64("v", "mask", F.lit(k))) for k in range(2))).alias("pat"))
        places = sites.select(F.col("pos").cast("int").alias("pos")).distinct().join(hashed, "pos", "left")
        # One number a pattern: its least place.
        first = places.groupBy("pat").agg(F.min("pos").alias("first"))
        places = saved(places.join(first, F.col("first").isNotNull() & places["pat"].eqNullSafe(first["pat"])).select("pos", F.col("first").alias("pat")))
        seen = masks.join(places.where("pos = pat").select("pos"), "pos", "left_semi").select("v", F.col("pos").alias("pat"), "mask")
        # An alignment has a bounded number of places: one row, which goes to the nodes.
        every = places.agg(F.array_sort(F.collect_set("pat")).alias("pats"))
        stay = 0.25 + 0.75 * F.exp(-4 * (F.col("t") + 1e-7) / 3)
        edges = tree.withColumn("stay", stay).withColumn("go", (1 - F.col("stay")) / 3).withColumn("m", _at(lambda i, j: F.col("stay" if i == j else "go"), 4, 4))
        grid = edges.join(F.broadcast(every)).select("v", "p", "m", F.explode("pats").alias("pat"))
        own = _at(lambda i: F.when(F.col("mask").isNull() | (F.col("mask").bitwiseAND(1 << i) > 0), 0.0).otherwise(float(np.log(TINY))), 4)
        rows = saved(grid.join(seen, ["v", "pat"], "left").select("v", "p", "pat", own.alias("b"), "m"))
        up = _upwards(rows)
        full = up.join(_downwards(rows, up), ["v", "pat"]).withColumn("f", _at(lambda i: F.col("x")[i] * F.col("g")[i], 4))
        best = F.array_position(F.transform("f", lambda f: f >= F.array_max("f") * (1 - NEAR)), True)
        states = full.select("v", "pat", F.substring(F.lit(STATES), best.cast("int"), F.lit(1)).alias("state"))
        out = states.join(places, "pat").select(F.col("v").cast("long").alias("node_id"), "pos", "state")
        return saved(out, keep=True)


def reconstruct(nodes: DataFrame, sites: DataFrame) -> DataFrame:
    """``node_id, pos, state`` of every node: the likeliest state, ties in ACGT order.

    ``nodes``: node_id, parent_id, branch_length.  ``sites``: node_id, pos,
    state of the tips; other letters and missing places are unknown.  Trees of
    over ``MAX_NODES`` nodes are never collected: they go to
    ``reconstruct_contracted``, which gives the same states.
    """
    rows = nodes.select("node_id", "parent_id", F.coalesce("branch_length", F.lit(0.0)).alias("length")).limit(MAX_NODES + 1).collect()
    if len(rows) > MAX_NODES:
        return reconstruct_contracted(nodes, sites)
    kids: dict = {}
    for r in rows:
        kids.setdefault(r["parent_id"], []).append(r)
    order, todo = [], list(kids.get(None, []))
    while todo:
        r = todo.pop()
        order.append(r)
        todo += kids.get(r["node_id"], [])
    seat = {r["node_id"]: i for i, r in enumerate(order)}
    parent = np.array([seat.get(r["parent_id"], -1) for r in order])
    shared = nodes.sparkSession.sparkContext.broadcast((seat, parent, np.array([r["length"] for r in order])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seat, parent, length = shared.value
        places, at = np.unique(pdf["pos"].to_numpy(), return_inverse=True)
        seen = np.ones((len(parent), len(places), 4))
        state = pdf["state"].map({c: k for k, c in enumerate(STATES)})
        known = state.notna().to_numpy() & pdf["node_id"].isin(seat).to_numpy()
        own, k = pdf["node_id"][known].map(seat).to_numpy(np.int64), state[known].astype(int).to_numpy()
        seen[own, at[known]] = 0.0
        seen[own, at[known], k] = 1.0
        full = marginals(parent, length, seen)
        best = (full >= full.max(2, keepdims=True) * (1 - NEAR)).argmax(2)
        ids = np.fromiter(seat, np.int64, len(seat))
        return pd.DataFrame({"node_id": np.repeat(ids, len(places)), "pos": np.tile(places, len(ids)), "state": np.array(list(STATES))[best.reshape(-1)]})

    # A task's arrays have a row for each node, place and state: the larger the tree, the fewer places.
    places = max(1, min(BLOCK, BLOCK_STATES // max(1, len(order))))
    blocks = sites.select("node_id", F.col("pos").cast("int").alias("pos"), F.upper("state").alias("state")).withColumn("_block", F.floor((F.col("pos") - 1) / places))
    return blocks.groupBy("_block").applyInPandas(run, "node_id long, pos int, state string")
