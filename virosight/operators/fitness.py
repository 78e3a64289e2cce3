"""Fitness models: standardised predictors, projection of clades, and a simplex fit with restarts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from virosight.operators.solvers import nelder_mead

#: Rows of (season, clade) sums that a fit may collect.
MAX_ROWS = 200_000


def fitness(df: DataFrame, weights: dict[str, float], out: str = "fitness") -> DataFrame:
    """Weighted sum of standardised predictors; a missing predictor adds nothing."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * F.coalesce(F.col(name), F.lit(0.0))
    return df.withColumn(out, total)


def project(df: DataFrame, by: list[str], clade: str, weight: str = "freq", score: str = "fitness") -> DataFrame:
    """Projected share of each clade: summed exp(fitness) times frequency over the group's sum."""
    each = df.groupBy(*by, clade).agg(F.sum(F.col(weight) * F.exp(score)).alias("_m"), F.sum(weight).alias("initial"))
    total = each.groupBy(*by).agg(F.sum("_m").alias("_all"))
    return each.join(total, by).select(*by, clade, "initial", (F.col("_m") / F.col("_all")).alias("projected"))


def projection_error(projected: DataFrame, observed: DataFrame, by: list[str], clade: str) -> DataFrame:
    """Mean absolute difference of projected and observed shares by group."""
    return projected.join(observed, [*by, clade]).groupBy(*by).agg(F.avg(F.abs(F.col("projected") - F.col("observed"))).alias("error"))


def learn(df: DataFrame, predictors: list[str], starts: int = 11, ridge: float = 1e-3, seed: int = 0) -> DataFrame:
    """Weights that minimise the projection error over seasons: ``start, error`` and a column for each predictor, all starts.

    ``df`` holds season, clade, freq, observed and the predictors, aggregated
    to one row a clade; only those sums reach the tasks, each of which runs
    some of the restarts (the first from zero).
    """
    rows = df.select("season", "clade", "freq", "observed", *predictors)
    if rows.limit(MAX_ROWS + 1).count() > MAX_ROWS:
        raise ValueError(f"over {MAX_ROWS} clades; aggregate first")
    spark = df.sparkSession
    data = spark.sparkContext.broadcast(rows.toPandas())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = data.value
        x, f, y = pdf[predictors].to_numpy(float), pdf["freq"].to_numpy(float), pdf["observed"].to_numpy(float)
        season = pd.factorize(pdf["season"])[0]

        def error(w: np.ndarray) -> float:
            m = f * np.exp(np.clip(x @ w, -50, 50))
            return float(np.abs(m / np.bincount(season, m)[season] - y).mean() + ridge * (w @ w))

        for batch in batches:
            out = []
            for k in batch["id"]:
                start = np.random.default_rng(seed + int(k)).normal(0, 1, len(predictors)) if k else np.zeros(len(predictors))
                w, e = nelder_mead(error, start)
                out.append((k, e, *w))
            yield pd.DataFrame(out, columns=["start", "error", *predictors])

    schema = "start long, error double" + "".join(f", {p} double" for p in predictors)
    return spark.range(starts).repartition(min(starts, 8)).mapInPandas(run, schema)
