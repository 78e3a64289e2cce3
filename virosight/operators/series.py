"""Windows over ordered series, histograms, and statistics of groups."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from virosight.operators.ordered import blocks_with_edges, running_totals, value_counts


def running_average(
    df: DataFrame, value: str, order: list[str], size: int, by: list[str] | None = None, out: str = "smooth", zero_padded: bool = False
) -> DataFrame:
    """Mean over ``size`` rows; edges divide by what is there, or by ``size`` if zero padded.

    Without groups the one order is cut in blocks that carry their edges along.
    """
    low, high = -(size // 2), size // 2 - (size + 1) % 2
    rows = df if by else blocks_with_edges(df, order, -low, high)
    own = Window.partitionBy(*(by or ["_block"])).orderBy(*order).rowsBetween(low, high)
    rows = rows.withColumn(out, F.sum(value).over(own) / size if zero_padded else F.avg(value).over(own))
    return rows if by else rows.where("_own").drop("_block", "_own")


def cumulative_share(df: DataFrame, value: str, order: list[str], by: list[str], out: str = "share") -> DataFrame:
    own = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(own) / F.sum(value).over(Window.partitionBy(*by)))


def change_ratio(df: DataFrame, value: str, order: str, lag: int, by: list[str], out: str = "ratio", pseudo: float = 0.01) -> DataFrame:
    """(f + c) / (f ``lag`` rows before + c); null where there is none."""
    own = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(out, (F.col(value) + pseudo) / (F.lag(value, lag).over(own) + pseudo))


def threshold_crossing(df: DataFrame, x: str, y: str, threshold: float, by: list[str]) -> DataFrame:
    """First place where each group's curve rises above the threshold: interpolated place, and slope there."""
    own = Window.partitionBy(*by).orderBy(x)
    seg = df.select(*by, x, y, F.lag(x).over(own).alias("x0"), F.lag(y).over(own).alias("y0")).where(F.col(y) > threshold)
    first = seg.groupBy(*by).agg(F.min(F.struct(x, y, "x0", "y0")).alias("s"))
    slope = (F.col(f"s.{y}") - F.col("s.y0")) / (F.col(f"s.{x}") - F.col("s.x0"))
    return first.select(*by, F.when(F.col("s.x0").isNull(), F.col(f"s.{x}")).otherwise(F.col("s.x0") + (threshold - F.col("s.y0")) / slope).alias("crossing"), slope.alias("slope"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts in equal half-open bins, the last one closed; values outside take no part."""
    width = (high - low) / bins
    inside = df.where((F.col(value) >= low) & (F.col(value) <= high))
    k = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int").alias("bin")
    return inside.groupBy(*(by or []), k).agg(F.count("*").alias("n"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], t: str, values: list[str]) -> DataFrame:
    """Each left row with the last right row of its group at or before its time (null if none).

    One shuffle by group of the union of both sides and a running last value;
    no range join, so a group's size counts once and not squared.
    """
    a = left.withColumn("_side", F.lit(1))
    b = right.select(*by, t, F.struct(*values).alias("_v")).withColumn("_side", F.lit(0))
    own = Window.partitionBy(*by).orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(own)).where("_side = 1")
    return both.select(*left.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def interval_join(points: DataFrame, intervals: DataFrame, t: str, start: str, end: str) -> DataFrame:
    """Points with the half-open intervals that hold them; meant for a few intervals, which Catalyst broadcasts."""
    return points.join(intervals, (F.col(t) >= F.col(start)) & (F.col(t) < F.col(end)))


def standardise(df: DataFrame, value: str, by: list[str], out: str = "z") -> DataFrame:
    """(x - mean) / population deviation of the group; null where the deviation is 0."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(stats, by).withColumn(out, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def validation(df: DataFrame, measured: str, predicted: str, by: list[str]) -> DataFrame:
    """Mean absolute and root mean square error, line of predicted on measured, and correlation."""
    e = F.col(measured) - F.col(predicted)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.regr_slope(predicted, measured).alias("slope"), F.regr_intercept(predicted, measured).alias("intercept"), F.corr(measured, predicted).alias("r"),
    )


def hit_rates(df: DataFrame, initial: Column, observed: Column, predicted: Column, by: list[str]) -> DataFrame:
    """Share of grown groups that were predicted to grow, and of shrunk ones predicted to shrink."""
    grew, fell = observed > initial, observed < initial
    return df.groupBy(*by).agg(F.avg(F.when(grew, (predicted > initial).cast("int"))).alias("growth"), F.avg(F.when(fell, (predicted < initial).cast("int"))).alias("decline"))


def ks_distance(df: DataFrame, value: str, group: str) -> DataFrame:
    """Largest distance of the two groups' cumulative shares; ``group`` is boolean, null values take no part.

    Values are counted first, and the counts are added up range by range.
    """
    yes = F.coalesce(F.col(group), F.lit(False)).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.sum(yes).alias("a"), F.sum(1 - yes).alias("b"))
    sums = counts.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    upto = running_totals(counts, [value], {"upto_a": "a", "upto_b": "b"}).join(F.broadcast(sums))
    return upto.agg(F.max(F.abs(F.try_divide("upto_a", "all_a") - F.try_divide("upto_b", "all_b"))).alias("ks"))


def rank_correlation(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Spearman correlation over average ranks of rows with both values.

    Ranks belong to values, not rows: they come from running totals of value
    counts, and pairs of values are counted before they meet their ranks.  The
    mean rank of n rows is (n + 1) / 2, so one pass sums centred products.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.forall(F.array(*(F.col(c).isNotNull() for c in by)), lambda c: c))
    pairs = rows.groupBy(*by, x, y).agg(F.count("*").alias("_n"))
    total = rows.groupBy(*by).agg(F.count("*").alias("_all"))
    for c, name in ((x, "_x"), (y, "_y")):
        ranks = value_counts(rows, c, by).select(*by, c, (F.col("before") + (F.col("n") + 1) / 2).alias(name))
        pairs = pairs.join(ranks, [*by, c])
    centred = {c: F.col(c) - (F.col("_all") + 1) / 2 for c in ("_x", "_y")}
    part = lambda p, q: F.sum(F.col("_n") * centred[p] * centred[q])
    sums = pairs.join(total, by).groupBy(*by).agg(part("_x", "_y").alias("_xy"), part("_x", "_x").alias("_xx"), part("_y", "_y").alias("_yy"))
    return sums.select(*by, F.try_divide("_xy", F.sqrt(F.col("_xx") * F.col("_yy"))).alias("rho"))


def poisson_copies(hashes: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Copies (rows x draws) that rows have in resamples of half the size: Poisson with mean 1/2, from mixed hashes of row and draw."""
    with np.errstate(over="ignore"):
        z = hashes[:, None].view(np.uint64) + (draws.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53
    upto = np.cumsum([math.exp(-0.5) * 0.5**k / math.factorial(k) for k in range(16)])
    return np.searchsorted(upto, u, side="right").astype(np.int64)


#: Numbers that a task of the bootstrap holds at most before it hands its counters on.
HELD = 4_000_000


def _counters(by: list[str], draws: int) -> Callable:
    """mapInPandas function over by, _s and _h: for each group two arrays with a counter a draw, of copies and of copies that succeed."""

    def rows(held: dict) -> pd.DataFrame:
        out = pd.DataFrame(list(held), columns=by, dtype=object)
        for i, name in enumerate(("_copies", "_hits")):
            out[name] = [v[i] for v in held.values()]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, step, all_ = {}, max(1, HELD // (8 * draws)), np.arange(draws)
        for pdf in batches:
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at : at + step]
                copies, hit = poisson_copies(part["_h"].to_numpy(np.int64), all_), part["_s"].to_numpy(np.int64)
                keys: dict = {}
                # A missing value of any kind is None, so that groups of nulls come together.
                for i, key in enumerate(zip(*(part[c].astype(object) for c in by), strict=True) if by else [()] * len(part)):
                    keys.setdefault(tuple(None if v is None or v != v else v for v in key), []).append(i)
                for key, own in keys.items():
                    if key not in held:
                        held[key] = np.zeros((2, draws), np.int64)
                    held[key][0] += copies[own].sum(0)
                    held[key][1] += hit[own] @ copies[own]
                if len(held) * 2 * draws > HELD:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    return run


def bootstrap_share(df: DataFrame, success: Column, key: list[str], by: list[str], draws: int = 100, seed: int = 0) -> DataFrame:
    """Mean and deviation over ``draws`` resamples of half the size of the share of successes.

    Each row draws its number of copies from a hash of key, draw and seed
    (Poisson with mean 1/2), so resamples need no shuffle of their own and a
    repeated task draws the same.  A task sums copies in an array with a
    counter a draw for each of its groups; only these are shuffled, no row for
    each draw.  Null successes count as failures; draws without copies are
    left out.
    """
    rows = df.select(*by, F.coalesce(success.cast("int"), F.lit(0)).alias("_s"), F.xxhash64(*key, F.lit(seed)).alias("_h"))
    shape = StructType([*(StructField(c, rows.schema[c].dataType) for c in by), *(StructField(c, ArrayType(LongType())) for c in ("_copies", "_hits"))])
    counters = rows.mapInPandas(_counters(by, draws), shape).select(*by, F.posexplode(F.arrays_zip("_copies", "_hits")).alias("_draw", "_c"))
    share = counters.groupBy(*by, "_draw").agg(F.try_divide(F.sum("_c._hits"), F.sum("_c._copies")).alias("share"))
    return share.groupBy(*by).agg(F.avg("share").alias("mean"), F.stddev_pop("share").alias("deviation"))


def month_region_counts(df: DataFrame, date: str, region: str) -> DataFrame:
    """Samples by year, month and region."""
    return df.groupBy(F.year(date).alias("year"), F.month(date).alias("month"), F.col(region).alias("region")).agg(F.count("*").alias("n"))


def month_region_table(df: DataFrame, date: str, region: str, regions: list[str]) -> DataFrame:
    """One row a month, one column a region, zeros filled in."""
    return df.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).pivot(region, regions).agg(F.count(F.lit(1))).na.fill(0)


def interval_statistics(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """``key, n, top, mean, deviation`` over the intervals that hold the key, nulls left out; largest first by ``top``."""
    out = df.groupBy(*key).agg(F.count(value).alias("n"), F.max(value).alias("top"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    return out.where("n > 0").orderBy(F.desc("top"), *key)


def interval_table(df: DataFrame, key: list[str], interval: str, value: str, intervals: list) -> DataFrame:
    """One row a key, one column an interval (the stated ones): a full outer merge with nulls where a key is missing."""
    return df.where(F.col(interval).isin(*intervals)).groupBy(*key).pivot(interval, intervals).agg(F.max(value))


def largest_changes(df: DataFrame, by: list[str], order: str, value: str, top: int = 30) -> DataFrame:
    """The ``top`` trajectories by their summed absolute change, largest first."""
    own = Window.partitionBy(*by).orderBy(order)
    steps = df.select(*by, F.abs(F.col(value) - F.lag(value).over(own)).alias("_d"))
    return steps.groupBy(*by).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("change")).orderBy(F.desc("change"), *by).limit(top)


def pick_best(df: DataFrame, by: list[str], value: str, order: list[str], least: bool = False) -> DataFrame:
    """The row of each group with the largest (or least) value, the first in ``order`` among equal ones."""
    from virosight.operators.curate import keep_first

    worth = F.col(value) if least else -F.col(value)
    return keep_first(df.where(F.col(value).isNotNull()), by, [worth, *order])


def band_of_two_errors(df: DataFrame, f: str, n: str, order: str, by: list[str]) -> DataFrame:
    """Adds ``n_mean`` (running mean of two counts), ``sigma`` and the band ``low, high`` of two errors around ``f``."""
    own = Window.partitionBy(*by).orderBy(order).rowsBetween(-1, 0)
    rows = df.withColumn("n_mean", F.avg(n).over(own))
    sigma = F.sqrt(F.col(f) * (1 - F.col(f)) / (F.col("n_mean") + 1))
    return rows.withColumn("sigma", sigma).withColumns({"low": F.col(f) - 2 * F.col("sigma"), "high": F.col(f) + 2 * F.col("sigma")})


def region_totals(df: DataFrame, date: str, region: str) -> DataFrame:
    """Samples by year and region, by year, and in all."""
    return df.rollup(F.year(date).alias("year"), F.col(region).alias("region")).agg(F.count("*").alias("n"))
