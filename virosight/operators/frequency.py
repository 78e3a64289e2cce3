"""Frequency trajectories: penalised Bernoulli fits of many features at once, and nested clades on a tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from virosight.operators.solvers import trajectory
from virosight.session import saved

#: Observations of a feature in one time bin are merged to weighted counts, so a fit's size is bounded by the grid.
BINS_PER_YEAR = 100


def fit_trajectories(obs: DataFrame, by: list[str], start: float, stop: float, per_year: int = 12, stiffness: float = 20.0, inertia: float = 0.0, date: str = "num_date", seen: str = "obs", min_obs: int = 5, samples: int | None = None) -> DataFrame:
    """``by, pivot, freq`` for each feature with enough observations of both kinds.

    Observations are first counted in narrow time bins by Spark, which bounds
    what a fitting task gets however many rows a feature has.  With
    ``samples``, the number of all samples, the stiffness is scaled by the
    share of them that a feature has observations of.
    """
    bins = obs.where((F.col(date) >= start) & (F.col(date) < stop)).groupBy(*by, bin_of(date)).agg(F.sum(F.col(seen).cast("int")).alias("_yes"), F.count("*").alias("_n"))
    return fit_bins(bins, by, start, stop, per_year, stiffness, inertia, min_obs, samples)


def bin_of(date: str):
    return ((F.floor(F.col(date) * BINS_PER_YEAR) + 0.5) / BINS_PER_YEAR).alias("_t")


def fit_bins(bins: DataFrame, by: list[str], start: float, stop: float, per_year: int = 12, stiffness: float = 20.0, inertia: float = 0.0, min_obs: int = 5, samples: int | None = None) -> DataFrame:
    """As ``fit_trajectories``, from counts ``_yes`` of ``_n`` in time bins ``_t``."""
    total = bins.groupBy(*by).agg(F.sum("_yes").alias("_a"), F.sum("_n").alias("_b")).where((F.col("_b") > 10) & (F.col("_a") > min_obs) & (F.col("_a") < F.col("_b") - min_obs)).select(*by)
    bins = bins.join(total, by, "left_semi")
    grid = np.arange(np.floor(start * per_year), np.ceil(stop * per_year) + 1) / per_year
    schema = ", ".join(f"{c} {k}" for c, k in bins.dtypes if c in by) + ", pivot double, freq double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.repeat(pdf["_t"].to_numpy(), 2)
        kind = np.tile([1.0, 0.0], len(pdf))
        weight = np.stack([pdf["_yes"], pdf["_n"] - pdf["_yes"]], 1).reshape(-1)
        f = trajectory(times, kind, grid, stiffness * (weight.sum() / samples if samples else 1.0), inertia, weight=weight)
        return pd.DataFrame({c: pdf[c].iloc[0] for c in by} | {"pivot": grid, "freq": f})

    return bins.groupBy(*by).applyInPandas(run, schema)


def with_region_groups(obs: DataFrame, groups: dict[str, list[str] | None], region: str = "region", out: str = "group") -> DataFrame:
    """A row for each region group a row belongs to; None stands for all regions."""
    labels = F.array(*(F.when(F.lit(True) if own is None else F.col(region).isin(own), F.lit(name)) for name, own in groups.items()))
    return obs.withColumn(out, F.explode(F.array_compact(labels)))


#: Tips of a tree at which the stiffness holds as it is given; it is scaled by the number of tips.
SCALE_TIPS = 2000.0


def child_shares(totals: np.ndarray, children: list[tuple[object, int, np.ndarray]], every: int, times: np.ndarray, grid: np.ndarray, stiffness: float, threshold: int, inertia: float = 0.0) -> tuple[list[tuple[object, np.ndarray]], np.ndarray]:
    """Shares of a parent on the grid: of its larger children in order of size, and what each of the others gets.

    ``totals`` are the parent's observations in the bins ``times``;
    ``children`` are (child, tips, observations in the bins) of those with
    ``threshold`` tips or more, and ``every`` is the number of all children.
    A child is fitted to the observations that the ones before it left over,
    and takes its frequency of what they left of the parent.  The last child
    of all is never fitted, and the first one with too few observations left
    ends the order: those that are not fitted share the rest evenly.
    """
    left, totals, out = np.ones(len(grid)), totals.astype(float).copy(), []
    for child, _, own in sorted(children, key=lambda c: (-c[1], c[0]))[: every - 1]:
        if totals.sum() <= threshold:
            break
        seen, kind = np.stack([own, np.maximum(totals - own, 0)], 1).reshape(-1), np.tile([1.0, 0.0], len(times))
        share = trajectory(np.repeat(times, 2), kind, grid, stiffness, inertia, weight=seen)
        out.append((child, left * share))
        left = left * (1 - share)
        totals = totals - own
    return out, left / max(1, every - len(out))


def tree_frequencies(nodes: DataFrame, closure: DataFrame, tips: DataFrame, start: float, stop: float, per_year: int = 12, stiffness: float = 20.0, threshold: int = 20, inertia: float = 0.0) -> DataFrame:
    """``node_id, region, pivot, freq`` of all clades of a tree: the root is 1 and children share their parent.

    ``tips``: node_id, region, num_date.  A parent's children are fitted one
    after another (``child_shares``), one group a parent and region, from
    counts in time bins; of children with fewer than ``threshold`` tips in the
    region only their sum is sent, so a group has no more rows than a parent
    has large children, times bins.  A clade's frequency is the product of the
    shares on its path, so no loop over the levels is needed.
    """
    dated = tips.select(F.col("node_id").alias("node"), "region", "num_date")
    inside = (F.col("num_date") >= start) & (F.col("num_date") < stop)
    counts = saved(closure.join(dated, "node").groupBy(F.col("ancestor").alias("node_id"), "region", F.when(inside, bin_of("num_date")).alias("_t")).agg(F.count("*").alias("_k")))
    edges = nodes.where("parent_id is not null").select("node_id", "parent_id")
    sizes = counts.groupBy("node_id", "region").agg(F.sum("_k").alias("_size"))
    large = sizes.where(F.col("_size") >= threshold).join(edges, "node_id")
    below = counts.where("_t is not null").join(large, ["node_id", "region"]).select("parent_id", "region", F.col("node_id").alias("child"), "_size", "_t", "_k")
    parents = edges.groupBy("parent_id").agg(F.count("*").alias("_every"))
    seen = sizes.select(F.col("node_id").alias("parent_id"), "region").join(parents, "parent_id")
    whole = counts.where("_t is not null").withColumnRenamed("node_id", "parent_id").join(seen, ["parent_id", "region"])
    # Large children without an observation in the window are there too, with a row without a bin.
    empty = large.select("parent_id", "region", F.col("node_id").alias("child"), "_size", F.lit(None).cast("double").alias("_t"), F.lit(0).cast("long").alias("_k"))
    total = tips.groupBy("region").agg(F.count("*").alias("_all"))
    none = F.lit(None)
    kind = dict(edges.dtypes)["node_id"]
    rows = below.unionByName(empty).withColumn("_every", none.cast("long")).unionByName(whole.select("parent_id", "region", none.cast(kind).alias("child"), none.cast("long").alias("_size"), "_t", "_k", "_every"))
    anchors = seen.select("parent_id", "region", none.cast(kind).alias("child"), none.cast("long").alias("_size"), none.cast("double").alias("_t"), F.lit(0).cast("long").alias("_k"), "_every")
    rows = rows.unionByName(anchors).join(total, "region")
    grid = np.arange(np.floor(start * per_year), np.ceil(stop * per_year) + 1) / per_year
    schema = f"parent_id {dict(edges.dtypes)['parent_id']}, region {dict(tips.dtypes)['region']}, child {kind}, pivot double, share double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bins = pdf[pdf["child"].isna()]
        times = np.sort(bins["_t"].dropna().unique())
        place = lambda g: np.bincount(np.searchsorted(times, g["_t"].dropna()), weights=g.loc[g["_t"].notna(), "_k"], minlength=len(times))
        children = [(int(c), int(g["_size"].iloc[0]), place(g)) for c, g in pdf[pdf["child"].notna()].groupby("child")]
        shares, rest = child_shares(place(bins), children, int(bins["_every"].iloc[0]), times, grid, stiffness * pdf["_all"].iloc[0] / SCALE_TIPS, threshold, inertia)
        out = pd.concat([pd.DataFrame({"child": pd.array([c] * len(grid), "Int64"), "pivot": grid, "share": s}) for c, s in [*shares, (None, rest)]])
        return out.assign(parent_id=pdf["parent_id"].iloc[0], region=pdf["region"].iloc[0])[["parent_id", "region", "child", "pivot", "share"]]

    fitted = saved(rows.groupBy("parent_id", "region").applyInPandas(run, schema))
    rest = fitted.where("child is null").select("parent_id", "region", "pivot", F.col("share").alias("_rest"))
    own = fitted.where("child is not null").select(F.col("child").alias("node_id"), "region", "pivot", "share")
    shares = edges.join(rest, "parent_id").join(own, ["node_id", "region", "pivot"], "left")
    shares = shares.select(F.col("node_id").alias("ancestor"), "region", "pivot", F.ln(F.greatest(F.coalesce("share", "_rest"), F.lit(1e-10))).alias("_l"))
    # Only clades with tips in the region, and what lies between them and the root.
    met = closure.join(sizes.select(F.col("node_id").alias("node"), "region"), "node")
    return met.join(shares, ["ancestor", "region"]).groupBy(F.col("node").alias("node_id"), "region", "pivot").agg(F.exp(F.sum("_l")).alias("freq"))


def lookup(freqs: DataFrame, region: str, genotype: str, pivots: DataFrame) -> DataFrame:
    """Trajectory of a genotype in a region on all pivots, zeros where there is none; a bare ``159S`` means the first subunit."""
    name = genotype if ":" in genotype else f"HA1:{genotype}"
    own = freqs.where((F.col("region") == region) & (F.col("feature") == name)).select("pivot", "freq")
    return pivots.join(own, "pivot", "left").select("pivot", F.round(F.coalesce("freq", F.lit(0.0)), 4).alias("freq"))


def filter_step(x: np.ndarray, rng: np.random.Generator, yes: int, n: int, dt: float, sigma: float) -> np.ndarray:
    """Particles after one step: drift by noise, then resampling by the likelihood of the step's counts."""
    x = np.clip(x + rng.normal(0, sigma * dt, len(x)) * np.sqrt(x * (1 - x)), 1e-5, 1 - 1e-5)
    if n:
        w = yes * np.log(x) + (n - yes) * np.log(1 - x)
        w = np.exp(w - w.max())
        x = x[rng.choice(len(x), len(x), p=w / w.sum())]
    return x


def particle_filter(obs: DataFrame, by: list[str], start: float, stop: float, particles: int = 500, dt: float = 0.01, sigma: float = 5.0, seed: int = 0, date: str = "num_date", seen: str = "obs") -> DataFrame:
    """Filtered frequency on every tenth step of ``dt`` years: drift by noise, weights by the counts of the step, resampling."""
    step = F.floor((F.col(date) - start) / dt).cast("int").alias("_k")
    counts = obs.where((F.col(date) >= start) & (F.col(date) < stop)).groupBy(*by, step).agg(F.sum(F.col(seen).cast("int")).alias("_yes"), F.count("*").alias("_n"))
    schema = ", ".join(f"{c} {k}" for c, k in counts.dtypes if c in by) + ", t double, freq double"
    steps = int(np.ceil((stop - start) / dt))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        at = pdf.set_index("_k")[["_yes", "_n"]].T.to_dict("list")
        x, rows = np.full(particles, 0.5), []
        for k in range(steps):
            x = filter_step(x, rng, *at.get(k, (0, 0)), dt, sigma)
            if k % 10 == 0:
                rows.append((start + k * dt, float(x.mean())))
        return pd.DataFrame(rows, columns=["t", "freq"]).assign(**{c: pdf[c].iloc[0] for c in by})[[*by, "t", "freq"]]

    return counts.groupBy(*by).applyInPandas(run, schema)
