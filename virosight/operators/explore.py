"""Point queries of the interactive views, as functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def colour_by(nodes: DataFrame, trait: str) -> DataFrame:
    return nodes.select("node_id", F.col(trait).alias("value"))


def domain(df: DataFrame, value: str, step: float | None = None) -> DataFrame:
    """Least and largest value moved out to multiples of a half, the step, and the bins between.

    Without a step it follows from the span: 0.5 below 5, 1 below 10, 2 below 20, else 3.
    """
    out = df.agg((F.floor(F.min(value) / 0.5) * 0.5).alias("low"), (F.ceil(F.max(value) / 0.5) * 0.5).alias("high"))
    span = F.col("high") - F.col("low")
    by_span = F.when(span < 5, 0.5).when(span < 10, 1.0).when(span < 20, 2.0).otherwise(3.0)
    out = out.withColumn("step", by_span if step is None else F.lit(float(step)))
    return out.withColumn("n_bins", F.ceil(span / F.col("step")).cast("int"))


def legend_match(value: Column, low: float, high: float) -> Column:
    """In (low, high]."""
    return (value > low) & (value <= high)


def search_strains(nodes: DataFrame, text: str) -> DataFrame:
    return nodes.where(F.contains(F.lower("strain"), F.lit(text.lower())))


def zoom(nodes: DataFrame, low: float, high: float, y: str = "yvalue") -> DataFrame:
    return nodes.where((F.col(y) >= low) & (F.col(y) < high))


def variable_positions(entropy: DataFrame, least: float = 0.05) -> DataFrame:
    return entropy.where(F.round("entropy", 4) > least)


def current_tips(tips: DataFrame, now: float, window: float, restrictions: dict[str, object], date: str = "num_date") -> DataFrame:
    """Tips of an age in (0, window) that meet all restrictions."""
    from virosight.operators.curate import attribute_filter

    age = now - F.col(date)
    return attribute_filter(tips.where((age > 0) & (age < window)), restrictions)


def measured_distances(titers: DataFrame, focus: str, potency: DataFrame | None = None, avidity: DataFrame | None = None) -> DataFrame:
    """Mean normalised titer of each tested strain against the focus reference, over its sera, less corrections if given."""
    rows = titers.where(F.col("ref") == focus)
    value = F.col("norm")
    if potency is not None:
        rows, value = rows.join(potency, "serum", "left"), value - F.coalesce("potency", F.lit(0.0))
    if avidity is not None:
        rows, value = rows.join(avidity, "test", "left"), value - F.coalesce("avidity", F.lit(0.0))
    return rows.groupBy("test").agg(F.avg(value).alias("distance"))


def most_measured_reference(titers: DataFrame) -> DataFrame:
    """The reference with most tested strains; ties go to the first by name."""
    return titers.groupBy("ref").agg(F.count_distinct("test").alias("n")).orderBy(F.desc("n"), "ref").limit(1)


def tooltip(nodes: DataFrame, titers: DataFrame, node: str) -> DataFrame:
    """One tip's record with its titers by serum."""
    own = nodes.where(F.col("strain") == node)
    values = titers.groupBy(F.col("test").alias("strain")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("/", "ref", "serum").alias("k"), "norm")))).alias("titers"))
    return own.join(values, "strain", "left")


def axis(nodes: DataFrame, by_time: bool, date: str = "num_date", x: str = "xvalue") -> DataFrame:
    """``node_id, x``: decimal date or distance from the root."""
    return nodes.select("node_id", F.col(date if by_time else x).cast("double").alias("x"))


def slide(nodes: DataFrame, spans: DataFrame, tips: DataFrame, now: float, window: float, restrictions: dict[str, object] | None = None) -> DataFrame:
    """The tables behind a moved date slider: ``node_id, n, freq, before, dfreq`` of all nodes.

    ``n`` counts the current tips below a node (of an age in (0, window) that
    meet the restrictions), ``freq`` is its share of all of them, ``before``
    the share one window earlier, and ``dfreq`` their ratio with 0.01 added.
    """
    from virosight.operators.tree import subtree_counts

    parts = []
    for at, name in ((now, "n"), (now - window, "_old")):
        held = current_tips(tips, at, window, restrictions or {}).select("node_id", F.lit(1).alias("_v"))
        counts = subtree_counts(spans, held, "_v", name)
        total = held.agg(F.greatest(F.count("*"), F.lit(1)).alias("_all"))
        parts.append(counts.join(F.broadcast(total)).select("node_id", name, (F.col(name) / F.col("_all")).alias("freq" if name == "n" else "before")))
    both = nodes.select("node_id").join(parts[0], "node_id").join(parts[1].drop("_old"), "node_id")
    return both.withColumn("dfreq", (F.col("freq") + 0.01) / (F.col("before") + 0.01))
