"""Trees as node tables (tree_id, node_id, parent_id, child_ord, branch_length, ...).

Orders use pre-order intervals, which come from ranking the walk around the
tree by doubling: log2(2 n) joins of 2 n rows for n nodes of any depth.  Sums
over subtrees and over root paths are running totals along that walk, and
recurrences are contracted (``contraction``), so none of them makes a row for
each pair of a node and an ancestor.  Only questions whose answer names such
pairs go through the closure (``ancestors``), built by doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from virosight.operators.contraction import linear_down, linear_up, nearest_marked
from virosight.operators.ordered import running_totals
from virosight.session import dropped, saved


def ancestors(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id", length: str | None = None) -> DataFrame:
    """Every pair of a node and itself or an ancestor, with the number of steps (and the path length) between them.

    ``node, ancestor, steps[, distance]``.  Path lengths sum the ``length`` of
    all edges from the node up to, not including, the ancestor's own edge.
    """
    weight = F.coalesce(F.col(length), F.lit(0.0)).cast("double") if length else F.lit(0.0)
    base = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), weight.alias("w"))
    jump = base.where("up is not null").select("node", F.col("up").alias("far"), "w")
    found = base.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("steps"), F.lit(0.0).alias("distance"))
    reach = 1
    jump, found = saved(jump), saved(found)
    rounds = max(1, nodes.count()).bit_length() + 1
    while not jump.isEmpty():
        if not (rounds := rounds - 1):
            raise ValueError("a node is its own ancestor")
        # found holds up to reach - 1 steps, jump exactly reach steps.
        step = jump.select(F.col("node").alias("ancestor"), "far", "w")
        more = found.join(step, "ancestor").select(
            "node", F.col("far").alias("ancestor"), (F.col("steps") + reach).alias("steps"), (F.col("distance") + F.col("w")).alias("distance")
        )
        twice = jump.select(F.col("node").alias("far"), F.col("far").alias("next"), F.col("w").alias("w2"))
        old = found, jump
        found = saved(found.unionByName(more))
        jump = saved(jump.join(twice, "far").select("node", F.col("next").alias("far"), (F.col("w") + F.col("w2")).alias("w")))
        for table in old:
            dropped(table)
        reach *= 2
    return found if length else found.drop("distance")


def _doubled(walk: DataFrame) -> DataFrame:
    """Each place of the walk takes over the sums and the pointer of the place that it points to."""
    ahead = walk.select(
        F.col("v").alias("to"), F.col("up").alias("to_up"), F.col("downs").alias("d2"), F.col("ups").alias("u2"), F.col("root").alias("r2"),
        F.col("to").alias("next"), F.col("to_up").alias("next_up"),
    )
    return walk.join(ahead, ["to", "to_up"], "left").select(
        "v", "up", F.col("next").alias("to"), F.col("next_up").alias("to_up"), (F.col("downs") + F.coalesce("d2", F.lit(0))).alias("downs"),
        (F.col("ups") + F.coalesce("u2", F.lit(0))).alias("ups"), F.coalesce("root", "r2").alias("root"),
    )


def intervals(nodes: DataFrame) -> DataFrame:
    """``node_id, root, pre, last, post, depth`` of every node: children in the order of ``child_ord``, then id.

    ``pre`` and ``post`` count from 0 within a root's tree; the descendants of
    a node, itself included, are those with ``pre`` from its ``pre`` to its
    ``last``.  The walk down and up every edge is a list; its suffix sums are
    doubled until all pointers have run out.  A cycle is an error.
    """
    own = Window.partitionBy("parent_id").orderBy("child_ord", "node_id")
    base = nodes.select("node_id", "parent_id", F.when(F.col("parent_id").isNotNull(), F.lead("node_id").over(own)).alias("sibling"))
    first = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.min_by("node_id", F.struct("child_ord", "node_id")).alias("child"))
    base = base.join(first, "node_id", "left")
    down = base.select(
        F.col("node_id").alias("v"), F.lit(0).alias("up"), F.coalesce("child", "node_id").alias("to"), F.col("child").isNull().cast("int").alias("to_up")
    )
    up = base.select(
        F.col("node_id").alias("v"), F.lit(1).alias("up"), F.coalesce("sibling", "parent_id").alias("to"), F.col("sibling").isNull().cast("int").alias("to_up")
    )
    one = F.lit(1).cast("long")
    walk = down.unionByName(up).withColumns({"downs": F.when(F.col("up") == 0, one).otherwise(0), "ups": F.when(F.col("up") == 1, one).otherwise(0)})
    walk = saved(walk.withColumn("root", F.when(F.col("to").isNull(), F.col("v"))))
    # A list of 2 n places has run out after log2(2 n) doublings, two to a table.
    for _ in range(((2 * max(1, nodes.count())).bit_length() + 1) // 2):
        before, walk = walk, saved(_doubled(_doubled(walk)))
        dropped(before)
    if not walk.where("to is not null").isEmpty():
        raise ValueError("a node is its own ancestor")
    there = walk.where("up = 0").select(F.col("v").alias("node_id"), "root", F.col("downs").alias("_d"), F.col("ups").alias("_u"))
    back = walk.where("up = 1").select(F.col("v").alias("node_id"), F.col("downs").alias("_d2"), F.col("ups").alias("_u2"))
    total = there.where("node_id = root").select("root", F.col("_d").alias("_n"))
    joined = there.join(back, "node_id").join(total, "root")
    pre = F.col("_n") - F.col("_d")
    return joined.select(
        "node_id", "root", pre.alias("pre"), (pre + F.col("_d") - F.col("_d2") - 1).alias("last"), (F.col("_n") - F.col("_u2")).alias("post"),
        (F.col("_u") - F.col("_d")).alias("depth"),
    )


#: Sums of lengths are exact in units of 1e-15, so that equal sums stay equal.
_EXACT = "decimal(38,15)"


def subtree_sums(spans: DataFrame, values: DataFrame, value: str, out: str, kind: str = "double") -> DataFrame:
    """``node_id, out``: sum of a column of ``values`` (node_id, value) over each node's descendants, itself included.

    Running totals over the pre-order, so a deep tree costs no more than a
    flat one.  ``kind`` is long or double; nulls count as 0.
    """
    exact = _EXACT if kind == "double" else "long"
    rows = spans.join(values.groupBy("node_id").agg(F.sum(F.col(value).cast(exact)).cast(exact).alias("_v")), "node_id", "left").withColumn("_v", F.coalesce("_v", F.lit(0)).cast(exact))
    upto = saved(running_totals(rows.select("node_id", "root", "pre", "last", "_v"), ["root", "pre"], {"_upto": "_v"}))
    ends = upto.select("root", F.col("pre").alias("last"), F.col("_upto").alias("_end"))
    return upto.join(ends, ["root", "last"]).select("node_id", (F.col("_end") - F.col("_upto") + F.col("_v")).cast(kind).alias(out))


def subtree_counts(spans: DataFrame, values: DataFrame, value: str, out: str = "n") -> DataFrame:
    """As ``subtree_sums``, of a whole-number column."""
    return subtree_sums(spans, values, value, out, "long")


def path_sums(spans: DataFrame, values: DataFrame, value: str, out: str) -> DataFrame:
    """``node_id, out``: sum of a column of ``values`` (node_id, value) over each node's path from the root, itself included.

    The walk around the tree adds a node's value where it is entered and takes
    it off where it is left; the running total at the entry is the path's.
    """
    rows = spans.join(values.groupBy("node_id").agg(F.sum(F.col(value).cast(_EXACT)).cast(_EXACT).alias("_v")), "node_id", "left").withColumn("_v", F.coalesce("_v", F.lit(0)).cast(_EXACT))
    enter = rows.select("node_id", "root", F.col("pre").alias("at"), F.lit(1).alias("enters"), "_v")
    leave = rows.select(F.lit(None).cast(dict(rows.dtypes)["node_id"]).alias("node_id"), "root", (F.col("last") + 1).alias("at"), F.lit(0).alias("enters"), (-F.col("_v")).cast(_EXACT).alias("_v"))
    total = running_totals(enter.unionByName(leave), ["root", "at", "enters"], {"_upto": "_v"})
    return total.where("enters = 1").select("node_id", F.col("_upto").cast("double").alias(out))


def subtree(closure: DataFrame, values: DataFrame, node: str, *aggs: Column) -> DataFrame:
    """Aggregates over each node's descendants, itself included: ``node_id`` and the aggregates of ``values``."""
    return closure.join(values.withColumnRenamed(node, "node"), "node").groupBy(F.col("ancestor").alias(node)).agg(*aggs)


def root_distance(nodes: DataFrame, length: str = "branch_length", spans: DataFrame | None = None) -> DataFrame:
    """Summed edge lengths from the root down to each node, the root's own edge included, and the depth."""
    spans = saved(intervals(nodes)) if spans is None else spans
    return path_sums(spans, nodes.select("node_id", length), length, "xvalue").join(spans.select("node_id", "depth"), "node_id")


def accumulate(nodes: DataFrame, values: DataFrame, value: str, out: str, spans: DataFrame | None = None) -> DataFrame:
    """Sum of a value over each node's path from the root."""
    return path_sums(saved(intervals(nodes)) if spans is None else spans, values, value, out)


def inherit(nodes: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """A node's own value, else that of the nearest ancestor with one; nodes without either are left out."""
    known = values.where(F.col(value).isNotNull()).select(F.col("node_id").alias("near"), value)
    return nearest_marked(nodes, known.select(F.col("near").alias("node_id"))).join(known, "near").select("node_id", value)


def trunk(nodes: DataFrame, tips: DataFrame, date: str, span: float, spans: DataFrame | None = None) -> DataFrame:
    """``node_id, trunk``: inner nodes from which all recent tips (within ``span`` of the last) descend."""
    spans = saved(intervals(nodes)) if spans is None else spans
    last = tips.agg(F.max(date).alias("_last"))
    recent = tips.join(F.broadcast(last)).where(F.col("_last") - F.col(date) < span).select("node_id", F.lit(1).alias("_one"))
    total = recent.join(nodes.select("node_id"), "node_id", "left_semi").agg(F.count("*").alias("_all"))
    held = subtree_counts(spans, recent, "_one", "_n").where("_n > 0")
    inner = nodes.join(tips.select("node_id"), "node_id", "left_anti").select("node_id")
    flagged = held.join(F.broadcast(total)).where("_n = _all").join(inner, "node_id", "left_semi").select("node_id", F.lit(True).alias("trunk"))
    return nodes.select("node_id").join(flagged, "node_id", "left").select("node_id", F.coalesce("trunk", F.lit(False)).alias("trunk"))


def ladderize(nodes: DataFrame, length: str = "branch_length", spans: DataFrame | None = None) -> DataFrame:
    """New child order: by the total edge length below, most first, then the old order."""
    spans = saved(intervals(nodes)) if spans is None else spans
    below = subtree_sums(spans, nodes.select("node_id", length), length, "below")
    own = Window.partitionBy("parent_id").orderBy(F.desc("below"), "child_ord", "node_id")
    return nodes.join(below, "node_id").withColumn("child_ord", F.row_number().over(own) - 1)


def collapse(nodes: DataFrame, gone: Column) -> DataFrame:
    """Nodes without those for which ``gone`` holds; their children hang from the nearest kept ancestor."""
    kept = nodes.where(~F.coalesce(gone, F.lit(False)) | F.col("parent_id").isNull())
    near = nearest_marked(nodes, kept.select("node_id")).select(F.col("node_id").alias("parent_id"), "near")
    return kept.join(near, "parent_id", "left").withColumn("parent_id", F.col("near")).select(*nodes.columns)


def prune(nodes: DataFrame, tips: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Nodes with one of the given tips below or at them: other tips and inner nodes left without tips go."""
    spans = saved(intervals(nodes)) if spans is None else spans
    alive = subtree_counts(spans, tips.select("node_id", F.lit(1).alias("_one")), "_one").where("n > 0")
    return nodes.join(alive, "node_id", "left_semi")


def reroot(nodes: DataFrame, outgroup: int, length: float = 0.001) -> DataFrame:
    """Tree without the outgroup tip; while the root has one child the root moves down, and its edge gets ``length``.

    The new root is the shallowest node that has not just one child: all above it lie on one chain.
    """
    kept = nodes.where(F.col("node_id") != outgroup)
    depth = intervals(kept).select("node_id", "depth")
    children = kept.groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("_c"))
    rows = kept.join(depth, "node_id").join(children, "node_id", "left").withColumn("_c", F.coalesce("_c", F.lit(0)))
    top = rows.where("_c <> 1").agg(F.min("depth").alias("_top"))
    rows = rows.join(F.broadcast(top)).where("depth >= _top").withColumn("parent_id", F.when(F.col("depth") > F.col("_top"), F.col("parent_id")))
    rooted = F.when(F.col("parent_id").isNull(), F.lit(length)).otherwise(F.col("branch_length"))
    return rows.withColumn("branch_length", rooted).select(*nodes.columns)


def mean_of_children(nodes: DataFrame, tips: DataFrame, value: str) -> DataFrame:
    """Tips keep their value; inner nodes get the mean of their children's, as a contracted recurrence.

    Nodes without a tip below are left out, and children without a value count as 0.
    """
    children = nodes.where("parent_id is not null").groupBy("parent_id").agg((1 / F.count("*")).alias("_share"))
    own = tips.select("node_id", F.col(value).cast("double").alias("_own"))
    rows = nodes.select("node_id", "parent_id").join(children, "parent_id", "left").join(own, "node_id", "left")
    held = subtree_counts(saved(intervals(nodes)), tips.select("node_id", F.lit(1).alias("_one")), "_one").where("n > 0")
    return linear_up(rows, "_own", "_share", value).join(held, "node_id", "left_semi")


def branching_index(nodes: DataFrame, alive: DataFrame, tau: float, length: str = "branch_length") -> DataFrame:
    """Local branching index: attenuated alive edge length around each node.

    An alive edge has the mass tau (1 - exp(-len / tau)).  ``_up`` sums the
    edges below a node, each weakened by its upper end's distance: a
    recurrence over children.  What comes from above is one over parents.
    ``alive`` lists the nodes whose edges count.
    """
    fade = lambda x: F.exp(-x / F.lit(tau))
    own = F.coalesce(F.col(length), F.lit(0.0))
    living = alive.select("node_id").distinct().withColumn("_alive", F.lit(True))
    mass = F.when(F.col("_alive") & F.col("parent_id").isNotNull(), tau * (1 - fade(own))).otherwise(0.0)
    edges = saved(nodes.join(living, "node_id", "left").select("node_id", "parent_id", own.alias("_len"), mass.alias("_m"), fade(own).alias("_fade")))
    masses = edges.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.sum("_m").alias("_below"))
    up = saved(edges.join(linear_up(edges.join(masses, "node_id", "left"), "_below", "_fade", "_up"), "node_id"))
    parent = up.select(F.col("node_id").alias("parent_id"), F.col("_up").alias("_parent_up"))
    around = F.col("_parent_up") - F.col("_up") * F.col("_fade") - F.col("_m")
    step = up.join(parent, "parent_id", "left").withColumn("_c", F.col("_m") + F.col("_fade") * around)
    return up.join(linear_down(step, "_c", "_fade", "_down"), "node_id").select("node_id", (F.col("_up") + F.col("_down")).alias("lbi"))


def path_between(closure: DataFrame, pairs: DataFrame, left: str, right: str, only: DataFrame | None = None) -> DataFrame:
    """Edges between two nodes of each pair: ancestors of exactly one of them, those of ``only`` (node_id) if given."""
    a = pairs.join(closure.select(F.col("node").alias(left), "ancestor"), left).withColumn("_s", F.lit(1))
    b = pairs.join(closure.select(F.col("node").alias(right), "ancestor"), right).withColumn("_s", F.lit(2))
    one = a.unionByName(b).groupBy(left, right, "ancestor").agg(F.count_distinct("_s").alias("_n")).where("_n = 1")
    path = one.select(left, right, F.col("ancestor").alias("node_id"))
    return path if only is None else path.join(only.select("node_id").distinct(), "node_id", "left_semi").select(left, right, "node_id")


def refine(nodes: DataFrame, gone: Column | None = None, ladder: bool = True) -> DataFrame:
    """Collapse, ladderize and lay out: the nodes with ``pre, last, clade`` (post-order), ``xvalue, yvalue``.

    ``gone`` marks inner nodes to collapse.  Tips stand at their place in leaf
    order, inner nodes at the mean of their children; x is the distance from
    the root.
    """
    kept = nodes
    if gone is not None:
        kept = saved(collapse(kept, gone))
    if ladder:
        kept = saved(ladderize(kept).select(*nodes.columns))
    spans = saved(intervals(kept))
    tips = kept.join(kept.select(F.col("parent_id").alias("node_id")).where("node_id is not null").distinct(), "node_id", "left_anti").select("node_id")
    seats = running_totals(spans.join(tips, "node_id", "left_semi").withColumn("_one", F.lit(1).cast("long")), ["root", "pre"], {"_y": "_one"})
    y = mean_of_children(kept, seats.select("node_id", F.col("_y").cast("double").alias("yvalue")), "yvalue")
    out = kept.join(spans.select("node_id", "pre", "last", F.col("post").alias("clade")), "node_id").join(root_distance(kept, spans=spans).drop("depth"), "node_id")
    return out.join(y, "node_id", "left")


def alive_in_window(nodes: DataFrame, spans: DataFrame, tips: DataFrame, date: str, start: float, end: float) -> DataFrame:
    """``node_id, alive``: tips dated in [start, end), and inner nodes with such a tip below."""
    inside = tips.where((F.col(date) >= start) & (F.col(date) < end)).select("node_id", F.lit(1).alias("_v"))
    counts = subtree_counts(spans, inside, "_v")
    return nodes.select("node_id").join(counts, "node_id").select("node_id", (F.col("n") > 0).alias("alive"))


def frequency_band(freqs: DataFrame, nodes: DataFrame, low: float = 0.1, high: float = 0.99, by: list[str] | None = None) -> DataFrame:
    """Rows (by, node_id, freq) with a frequency in [low, high) and strictly below their parent's."""
    by = by or []
    above = freqs.select(*by, F.col("node_id").alias("parent_id"), F.col("freq").alias("_f"))
    inside = freqs.where((F.col("freq") >= low) & (F.col("freq") < high)).join(nodes.select("node_id", "parent_id"), "node_id")
    return inside.join(above, [*by, "parent_id"]).where("freq < _f").select(*freqs.columns)


def fill_from_children(nodes: DataFrame, tips: DataFrame, value: str, how: str = "mean") -> DataFrame:
    """``node_id, value`` of all nodes: own value of tips, and least, largest or mean of the children's for inner ones."""
    if how == "mean":
        return mean_of_children(nodes, tips, value)
    agg = {"min": F.min, "max": F.max}[how](value).alias(value)
    return subtree(ancestors(nodes), tips.select("node_id", value), "node_id", agg)


def mark_choices(nodes: DataFrame, choices: DataFrame, annotations: DataFrame) -> DataFrame:
    """Adds ``choice_date`` of tips whose strain is in ``choices`` (strain, choice_date) and the ``label`` of annotated nodes (node_id, label)."""
    chosen = choices.groupBy("strain").agg(F.min("choice_date").alias("choice_date"))
    labels = annotations.groupBy("node_id").agg(F.min("label").alias("label"))
    return nodes.join(chosen, "strain", "left").join(labels, "node_id", "left")


def sampled_paths(closure: DataFrame, tips: DataFrame, year: str, seed: int = 0) -> DataFrame:
    """``year, tip, node_id, steps``: the path to the root of one tip of each year, drawn by a hash of its id."""
    drawn = tips.groupBy(year).agg(F.min_by("node_id", F.struct(F.xxhash64("node_id", F.lit(seed)), "node_id")).alias("tip"))
    return closure.withColumnRenamed("node", "tip").join(drawn, "tip").select(year, "tip", F.col("ancestor").alias("node_id"), "steps")


def branch_classes(closure: DataFrame, measured: DataFrame) -> DataFrame:
    """``node_id, n_measured, branch_class``: nodes with over one measured tip; equal tip sets share a class.

    On a chain of such nodes the tip set is named by its least tip and size.
    """
    sets = closure.join(measured.select(F.col("node_id").alias("node")), "node", "left_semi").groupBy(F.col("ancestor").alias("node_id")).agg(F.min("node").alias("_first"), F.count("*").alias("n_measured")).where("n_measured > 1")
    return sets.select("node_id", "n_measured", F.hash("_first", "n_measured").alias("_h"), "_first").withColumn("branch_class", F.concat_ws(":", "_first", "n_measured")).drop("_h", "_first")
