"""Trajectories of mutations, two-site genotypes and clades: counts by time bin from joins, then one fit a feature."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from virosight.operators.frequency import bin_of, fit_bins, tree_frequencies, with_region_groups

#: Region groups of the site; None stands for all regions.
REGION_GROUPS = {
    "global": None,
    "NA": ["north_america"],
    "EU": ["europe"],
    "AS": ["china", "south_asia", "japan_korea", "southeast_asia"],
    "OC": ["oceania"],
}


def between(freqs: DataFrame, threshold: float) -> DataFrame:
    """States with a frequency strictly between the threshold and one less it."""
    return freqs.where((F.col("freq") > threshold) & (F.col("freq") < 1 - threshold))


def mutation_bins(sites: DataFrame, states: DataFrame, by: list[str], date: str = "num_date") -> DataFrame:
    """``by, gene, pos, state, _t, _yes, _n``: samples with each wanted state, of all with the position, in time bins.

    ``sites``: by, gene, pos, state, date, a row a sample and place.  Counts
    are aggregated by state first, so nothing is multiplied by the states.
    """
    places = states.select("gene", "pos").distinct()
    rows = sites.join(places, ["gene", "pos"], "left_semi")
    each = rows.groupBy(*by, "gene", "pos", "state", bin_of(date)).agg(F.count("*").alias("_yes"))
    every = each.groupBy(*by, "gene", "pos", "_t").agg(F.sum("_yes").alias("_n"))
    wanted = every.join(states.select("gene", "pos", "state").distinct(), ["gene", "pos"])
    keys = [*by, "gene", "pos", "state", "_t"]
    return wanted.join(each, keys, "left").select(*keys, F.coalesce("_yes", F.lit(0)).alias("_yes"), "_n")


def mutation_name():
    """``gene:posSTATE``."""
    return F.concat(F.col("gene"), F.lit(":"), F.col("pos").cast("string"), F.col("state"))


def mutation_trajectories(sites: DataFrame, freqs: DataFrame, by: list[str], start: float, stop: float, threshold: float = 0.01, **fit) -> DataFrame:
    """``by, feature, pivot, freq`` (3 digits) of all states between the threshold and one less it."""
    inside = sites.where((F.col("num_date") >= start) & (F.col("num_date") < stop))
    bins = mutation_bins(inside, between(freqs, threshold), by).withColumn("feature", mutation_name())
    out = fit_bins(bins.select(*by, "feature", "_t", "_yes", "_n"), [*by, "feature"], start, stop, **fit)
    return out.withColumn("freq", F.round("freq", 3))


def effect_states(effects: DataFrame, least: float) -> DataFrame:
    """``gene, pos, state``: ancestral and derived state of each mutation (``gene:A12T``) with an effect of ``least`` or more."""
    part = lambda k: F.regexp_extract("mutation", r"^(.+):([^\d]+)(\d+)([^\d]+)$", k)
    rows = effects.where(F.col("value") >= least).select(part(1).alias("gene"), part(3).try_cast("int").alias("pos"), F.array(part(2), part(4)).alias("s"))
    return rows.where("pos is not null").select("gene", "pos", F.explode("s").alias("state")).distinct()


def effect_trajectories(sites: DataFrame, effects: DataFrame, by: list[str], start: float, stop: float, least: float = 0.1, **fit) -> DataFrame:
    """As ``mutation_trajectories``, of both states of the mutations with large antigenic effects."""
    inside = sites.where((F.col("num_date") >= start) & (F.col("num_date") < stop))
    bins = mutation_bins(inside, effect_states(effects, least), by).withColumn("feature", mutation_name())
    out = fit_bins(bins.select(*by, "feature", "_t", "_yes", "_n"), [*by, "feature"], start, stop, **fit)
    return out.withColumn("freq", F.round("freq", 3))


def pair_bins(sites: DataFrame, states: DataFrame, key: str, by: list[str], date: str = "num_date") -> DataFrame:
    """``by, feature, _t, _yes, _n`` of ordered pairs of variable places and their states within samples.

    Only the variable places take part, so a sample makes as many rows as it
    has pairs of those, whatever the length of its sequence.
    """
    rows = sites.join(states.select("gene", "pos", "state").distinct(), ["gene", "pos", "state"], "left_semi").select(key, *by, date, "gene", "pos", "state")
    other = rows.select(key, F.col("gene").alias("gene2"), F.col("pos").alias("pos2"), F.col("state").alias("state2"))
    pairs = rows.join(other, key).where("gene < gene2 or (gene = gene2 and pos < pos2)")
    places = [*by, "gene", "pos", "gene2", "pos2", "_t"]
    each = pairs.withColumn("_t", bin_of(date)).groupBy(*places, "state", "state2").agg(F.count("*").alias("_yes"))
    every = each.groupBy(*places).agg(F.sum("_yes").alias("_n"))
    seen = each.drop("_t", "_yes").distinct()
    whole = every.join(seen, [c for c in places if c != "_t"]).join(each, [*places, "state", "state2"], "left")
    one, two = mutation_name(), F.concat(F.col("gene2"), F.lit(":"), F.col("pos2").cast("string"), F.col("state2"))
    return whole.select(*by, F.concat_ws("/", one, two).alias("feature"), "_t", F.coalesce("_yes", F.lit(0)).alias("_yes"), "_n")


def genotype_trajectories(sites: DataFrame, freqs: DataFrame, key: str, by: list[str], start: float, stop: float, threshold: float = 0.1, **fit) -> DataFrame:
    """``by, feature, pivot, freq`` of two-site genotypes of the states between the threshold and one less it."""
    inside = sites.where((F.col("num_date") >= start) & (F.col("num_date") < stop))
    return fit_bins(pair_bins(inside, between(freqs, threshold), key, by), [*by, "feature"], start, stop, **fit)


def clade_members(sites: DataFrame, designations: DataFrame, key: str) -> DataFrame:
    """``clade, key``: samples that hold every (gene, pos, aa) of a clade's designation."""
    wanted = designations.select("clade", "gene", "pos", F.col("aa").alias("state")).distinct()
    needed = wanted.groupBy("clade").agg(F.count("*").alias("_all"))
    met = sites.join(wanted, ["gene", "pos", "state"]).groupBy("clade", key).agg(F.count_distinct("gene", "pos", "state").alias("_k"))
    return met.join(needed, "clade").where("_k = _all").select("clade", key)


def clade_bins(samples: DataFrame, members: DataFrame, key: str, by: list[str], date: str = "num_date") -> DataFrame:
    """``by, clade, _t, _yes, _n``: members of each clade among all samples, in time bins."""
    every = samples.groupBy(*by, bin_of(date)).agg(F.count("*").alias("_n"))
    each = samples.join(members, key).groupBy(*by, "clade", bin_of(date)).agg(F.count("*").alias("_yes"))
    clades = members.select("clade").distinct()
    whole = every.join(F.broadcast(clades)).join(each, [*by, "clade", "_t"], "left")
    return whole.select(*by, "clade", "_t", F.coalesce("_yes", F.lit(0)).alias("_yes"), "_n")


def clade_trajectories(samples: DataFrame, members: DataFrame, key: str, by: list[str], start: float, stop: float, **fit) -> DataFrame:
    """``by, clade, pivot, freq`` of designated clades; ``samples``: key, by, num_date."""
    inside = samples.where((F.col("num_date") >= start) & (F.col("num_date") < stop))
    return fit_bins(clade_bins(inside, members, key, by), [*by, "clade"], start, stop, **fit)


def censored_slopes(nodes: DataFrame, closure: DataFrame, tips: DataFrame, seasons: list[tuple[int, float, float]], **fit) -> DataFrame:
    """``node_id, season, dfreq``: slope of a clade's logit frequency up to the end of each season (number, start, end).

    Only tips of the season are used, so nothing later is known; logits are
    held within 25, and the first two pivots are left out.
    """
    parts = []
    for season, start, end in seasons:
        freqs = tree_frequencies(nodes, closure, tips.where((F.col("num_date") >= start) & (F.col("num_date") < end)), start, end, **fit)
        # The third pivot, by the formula that makes them.
        first = (math.floor(start * fit.get("per_year", 12)) + 2) / fit.get("per_year", 12)
        x = F.ln(F.greatest("freq", F.lit(1e-12)) / F.greatest(1 - F.col("freq"), F.lit(1e-12)))
        rows = freqs.where(F.col("pivot") >= first - 1e-9).withColumn("_x", F.greatest(F.least(x, F.lit(25.0)), F.lit(-25.0)))
        parts.append(rows.groupBy("node_id", "region").agg(F.regr_slope("_x", "pivot").alias("dfreq")).withColumn("season", F.lit(season)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("node_id", "region", "season", "dfreq")


def estimate(tasks: dict[str, Callable[[DataFrame], DataFrame]], obs: DataFrame, groups: dict[str, list[str] | None] | None = None) -> dict[str, DataFrame]:
    """Runs named tasks on the observations of each region group (column ``group``): each is a function of that table.

    Groups are a mapping of labels to regions; rows are multiplied by their
    groups once, for all tasks alike.
    """
    grouped = with_region_groups(obs, groups or REGION_GROUPS)
    return {name: task(grouped) for name, task in tasks.items()}
