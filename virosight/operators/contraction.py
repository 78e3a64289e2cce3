"""Linear recurrences along a tree of any depth, by contraction: neither a closure nor a loop over the levels.

Upwards a node's value is its own term and a multiple of each child's value;
downwards it is its own term and a multiple of its parent's.  Downwards the
steps are composed by doubling.  Upwards each round takes the leaves off
(rake) and folds every chain of nodes with one child left into one step
(compress, by doubling along the chain), which leaves less than half of the
nodes, so a ladder and a bush alike take about log(n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from virosight.session import dropped, saved, scratch


def linear_down(nodes: DataFrame, own: str, factor: str, out: str) -> DataFrame:
    """``node_id, out``: a node's ``own`` and ``factor`` times its parent's value (a root's value is its own).

    ``nodes``: node_id, parent_id, own, factor.  Nulls count as 0.  A cycle is an error.
    """
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double")
    with scratch():
        step = saved(nodes.select("node_id", F.col("parent_id").alias("to"), number(own).alias("b"), number(factor).alias("a")))
        rounds = max(1, step.count()).bit_length() + 1
        while not step.where("to is not null").isEmpty():
            if not (rounds := rounds - 1):
                raise ValueError("a node is its own ancestor")
            ahead = step.select(F.col("node_id").alias("to"), F.col("to").alias("next"), F.col("b").alias("b2"), F.col("a").alias("a2"))
            before = step
            joined = step.join(ahead, "to", "left")
            # A pointer to no known node is a root's.
            step = saved(joined.select("node_id", F.col("next").alias("to"), (F.col("b") + F.coalesce(F.col("a") * F.col("b2"), F.lit(0.0))).alias("b"), F.coalesce(F.col("a") * F.col("a2"), F.col("a")).alias("a")))
            dropped(before)
        return saved(step.select("node_id", F.col("b").alias(out)), keep=True)


def _chains(open_: DataFrame) -> DataFrame:
    """``v, to, a, b, p, up`` of open nodes with one open child: value = b + a * value(to), ``to`` having not just one child; the node's parent and factor."""
    child = open_.select(F.col("p").alias("v"), F.col("v").alias("to"), F.col("a").alias("a"), (F.col("k") == 1).alias("more"))
    unary = open_.where("k = 1").select("v", "b", "p", F.col("a").alias("up"))
    jump = saved(unary.join(child.where("v is not null"), "v").select("v", "to", "a", "b", "p", "up", "more"))
    rounds = max(1, jump.count()).bit_length() + 1
    while not jump.where("more").isEmpty():
        if not (rounds := rounds - 1):
            raise ValueError("a node is its own ancestor")
        ahead = jump.select(F.col("v").alias("to"), F.col("to").alias("next"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("more").alias("more2"))
        joined = jump.join(ahead, "to", "left")
        moved = F.col("next").isNotNull()
        before = jump
        jump = saved(
            joined.select(
                "v", F.coalesce("next", "to").alias("to"), F.when(moved, F.col("a") * F.col("a2")).otherwise(F.col("a")).alias("a"),
                F.when(moved, F.col("b") + F.col("a") * F.col("b2")).otherwise(F.col("b")).alias("b"), "p", "up", F.coalesce("more2", F.lit(False)).alias("more"),
            )
        )
        dropped(before)
    return jump


def linear_up(nodes: DataFrame, own: str, factor: str, out: str) -> DataFrame:
    """``node_id, out``: a node's ``own`` and the sum over its children of their ``factor`` times their value.

    ``nodes``: node_id, parent_id, own, factor.  Nulls count as 0; parents
    that are no nodes are left out.  A cycle is an error.
    """
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double")
    with scratch():
        base = nodes.select(F.col("node_id").alias("v"), F.col("parent_id").alias("p"), number(factor).alias("a"), number(own).alias("b"))
        children = base.where("p is not null").groupBy(F.col("p").alias("v")).agg(F.count("*").alias("k"))
        open_ = saved(base.join(children, "v", "left").withColumn("k", F.coalesce("k", F.lit(0))))
        values, folded = [], []
        count = open_.count()
        while count:
            done = saved(open_.where("k = 0").select("v", F.col("b").alias("x"), "p", "a"))
            values.append(done.select("v", "x"))
            sent = done.where("p is not null").groupBy(F.col("p").alias("v")).agg(F.sum(F.col("a") * F.col("x")).alias("_b"), F.count("*").alias("_k"))
            rest = saved(open_.where("k > 0").join(sent, "v", "left").select("v", "p", "a", (F.col("b") + F.coalesce("_b", F.lit(0.0))).alias("b"), (F.col("k") - F.coalesce("_k", F.lit(0))).alias("k")))
            jump = _chains(rest)
            folded.append(jump.select("v", "to", "a", "b"))
            # The top of a chain hands its parent over to the node that the chain leads to, and its own term to the parent.
            inner = jump.select(F.col("v").alias("p"))
            tops = saved(jump.join(inner, "p", "left_anti"))
            heirs = tops.select(F.col("to").alias("v"), F.col("p").alias("_p"), (F.col("up") * F.col("a")).alias("_a"), F.lit(True).alias("_moved"))
            given = tops.where("p is not null").groupBy(F.col("p").alias("v")).agg(F.sum(F.col("up") * F.col("b")).alias("_b"))
            moved = F.coalesce("_moved", F.lit(False))
            before = open_
            open_ = saved(
                rest.where("k <> 1").join(heirs, "v", "left").join(given, "v", "left")
                .select("v", F.when(moved, F.col("_p")).otherwise(F.col("p")).alias("p"), F.when(moved, F.col("_a")).otherwise(F.col("a")).alias("a"), (F.col("b") + F.coalesce("_b", F.lit(0.0))).alias("b"), "k")
            )
            for table in (before, rest):
                dropped(table)
            last, count = count, open_.count()
            if count >= last:
                raise ValueError("a node is its own ancestor")
        result = values[0] if values else base.select("v", F.col("b").alias("x"))
        for more in values[1:]:
            result = result.unionByName(more)
        result = saved(result)
        for jump in reversed(folded):
            if not jump.isEmpty():
                met = jump.join(result.withColumnRenamed("v", "to"), "to").select("v", (F.col("b") + F.col("a") * F.col("x")).alias("x"))
                before, result = result, saved(result.unionByName(met))
                dropped(before)
        return saved(result.select(F.col("v").alias("node_id"), F.col("x").alias(out)), keep=True)


def nearest_marked(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """``node_id, near``: the node itself if it is in ``marked`` (node_id), else its nearest marked ancestor; null if there is none."""
    with scratch():
        marks = marked.select("node_id").distinct().withColumn("_m", F.lit(True))
        known = nodes.join(marks, "node_id", "left").select("node_id", F.when(F.col("_m"), F.col("node_id")).otherwise(F.col("parent_id")).alias("to"), F.coalesce("_m", F.lit(False)).alias("done"))
        step = saved(known.withColumn("done", F.col("done") | F.col("to").isNull()))
        rounds = max(1, step.count()).bit_length() + 1
        while not step.where("not done").isEmpty():
            if not (rounds := rounds - 1):
                raise ValueError("a node is its own ancestor")
            ahead = step.select(F.col("node_id").alias("to"), F.col("to").alias("_to"), F.col("done").alias("_done"))
            before = step
            open_ = step.where("not done").join(ahead, "to", "left").select("node_id", F.col("_to").alias("to"), (F.coalesce("_done", F.lit(True)) | F.col("_to").isNull()).alias("done"))
            step = saved(step.where("done").unionByName(open_))
            dropped(before)
        return saved(step.select("node_id", F.col("to").alias("near")), keep=True)
