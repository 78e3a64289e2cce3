"""Predictors of clade growth by name, allele-frequency errors, model comparison and yearly back-tests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from virosight.operators import fitness, series, sites, tree
from virosight.session import saved


@dataclass
class Context:
    """Tables that predictors are made of.

    ``nodes``: a node table; ``tips``: node_id, season, num_date; ``scores``:
    node_id and any of ep, ne, rb, tol, chi; ``slopes``: node_id, season, dfreq.
    """

    nodes: DataFrame
    tips: DataFrame
    scores: DataFrame | None = None
    slopes: DataFrame | None = None
    tau: float = 0.0005
    seasons: list[int] = field(default_factory=list)


def _branching(c: Context) -> DataFrame:
    parts = []
    spans = saved(tree.intervals(c.nodes))
    for season in c.seasons:
        own = c.tips.where(F.col("season") == season).select("node_id", F.lit(1).alias("_one"))
        alive = tree.subtree_counts(spans, own, "_one").where("n > 0").select("node_id")
        parts.append(tree.branching_index(c.nodes, alive, c.tau).select("node_id", F.lit(season).alias("season"), F.col("lbi").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _score(name: str) -> Callable[[Context], DataFrame]:
    """A score of nodes that doesn't change from season to season."""

    def run(c: Context) -> DataFrame:
        every = c.tips.select("season").distinct()
        return c.scores.select("node_id", F.col(name).cast("double").alias("value")).join(F.broadcast(every))

    return run


#: Predictors by name, each a function of a context to ``node_id, season, value``.
PREDICTORS: dict[str, Callable[[Context], DataFrame]] = {
    "lb": _branching,
    "ep": _score("ep"),
    "ne": _score("ne"),
    "ne_star": _score("ne_star"),
    "rb": _score("rb"),
    "tol": _score("tol"),
    "cHI": _score("chi"),
    "dfreq": lambda c: c.slopes.select("node_id", "season", F.col("dfreq").alias("value")),
}


def evaluate(context: Context, names: list[str]) -> DataFrame:
    """``node_id, season`` of tips and a standardised column for each predictor, over each season's tips."""
    out = context.tips.select("node_id", "season").distinct()
    for name in names:
        own = PREDICTORS[name](context).select("node_id", "season", F.col("value").alias(name))
        out = series.standardise(out.join(own, ["node_id", "season"], "left"), name, ["season"], "_z").withColumn(name, F.col("_z")).drop("_z")
    return out


def predicted_frequencies(long: DataFrame, score: str, by: list[str]) -> DataFrame:
    """``by, pos, state, freq``: frequencies of states among tips weighted by exp(score); ``long``: by, pos, state, score."""
    return sites.site_frequencies(long, by=by, weight=F.exp(score)).select(*by, "pos", "state", "freq")


def diversity(freqs: DataFrame, by: list[str]) -> DataFrame:
    """``by, diameter``: summed p (1 - p) over places and states."""
    return freqs.groupBy(*by).agg(F.sum(F.col("freq") * (1 - F.col("freq"))).alias("diameter"))


def allele_error(predicted: DataFrame, future: DataFrame, by: list[str]) -> DataFrame:
    """``by, error``: summed predicted (1 - future) over places and states, less the future's own diameter.

    States that the future does not hold count as 0 there.
    """
    later = future.select(*by, "pos", "state", F.col("freq").alias("_f"))
    joined = predicted.join(later, [*by, "pos", "state"], "left").groupBy(*by).agg(F.sum(F.col("freq") * (1 - F.coalesce("_f", F.lit(0.0)))).alias("_e"))
    return joined.join(diversity(future, by), by).select(*by, (F.col("_e") - F.col("diameter")).alias("error"))


def predicted_distance(long: DataFrame, predicted: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``by, key, distance``: a tip's summed 1 - predicted frequency of its states, over the predicted places."""
    p = predicted.select(*by, "pos", "state", F.col("freq").alias("_p"))
    places = predicted.select(*by, "pos").distinct()
    rows = long.join(places, [*by, "pos"], "left_semi").join(p, [*by, "pos", "state"], "left")
    return rows.groupBy(*by, key).agg(F.sum(1 - F.coalesce("_p", F.lit(0.0))).alias("distance"))


def compare_models(df: DataFrame, models: dict[str, list[str]], starts: int = 3) -> DataFrame:
    """``model, start, error``: the fit of each set of predictors (see ``fitness.learn``), best start first within a model."""
    out = None
    for name, predictors in models.items():
        own = fitness.learn(df, predictors, starts).select(F.lit(name).alias("model"), "start", "error")
        out = own if out is None else out.unionByName(own)
    return out.orderBy("model", "error", "start")


def merged_features(trajectories: DataFrame, near: float = 0.25) -> DataFrame:
    """``feature, like``: pairs of features whose trajectories differ by less than ``near`` of their height throughout."""
    height = trajectories.groupBy("feature").agg(F.max("freq").alias("_top"))
    t = saved(trajectories.select("feature", "pivot", "freq").join(height, "feature"))
    other = t.select(F.col("feature").alias("like"), "pivot", F.col("freq").alias("_g"))
    pairs = t.join(other, "pivot").where("feature < like").groupBy("feature", "like")
    gap = pairs.agg(F.max(F.abs(F.col("freq") - F.col("_g"))).alias("_d"), F.max("_top").alias("_top"))
    return gap.where(F.col("_d") / (F.col("_top") + 0.1) < near).select("feature", "like")


def back_test(long: DataFrame, years: list[int], score: str, key: str = "node_id", date: str = "num_date") -> DataFrame:
    """``year, picked, picked_distance, mean_distance``: how near the best-scored current tip is to the year after.

    ``long``: key, pos, state, date, score.  Tips from May to February are
    current, those from the September after to June the future.  Distances are
    1 - mean frequency of a tip's states in the future; the mean is over all
    current tips.
    """
    out = None
    for year in years:
        now = long.where((F.col(date) >= year - 8 / 12) & (F.col(date) < year + 2 / 12))
        later = long.where((F.col(date) >= year + 8 / 12) & (F.col(date) < year + 18 / 12))
        future = sites.site_frequencies(later).select("pos", "state", F.col("freq").alias("_f"))
        each = now.join(future, ["pos", "state"], "left").groupBy(key).agg(F.avg(1 - F.coalesce("_f", F.lit(0.0))).alias("_d"), F.max(score).alias("_s"))
        row = each.agg(F.max_by(F.struct(key, "_d"), F.struct("_s", key)).alias("b"), F.avg("_d").alias("mean_distance"))
        row = row.select(F.lit(year).alias("year"), F.col(f"b.{key}").alias("picked"), F.col("b._d").alias("picked_distance"), "mean_distance").where("picked is not null")
        out = row if out is None else out.unionByName(row)
    return out
