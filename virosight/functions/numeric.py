"""Column functions on frequencies, pivots and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def logit(x: Column) -> Column:
    """ln(x / (1 - x)), both sides floored at 1e-10."""
    return F.ln(F.greatest(x, F.lit(1e-10)) / F.greatest(1 - x, F.lit(1e-10)))


def inverse_logit(x: Column, bound: float = 7.0) -> Column:
    y = F.greatest(F.least(x, F.lit(bound)), F.lit(-bound))
    return F.exp(y) / (1 + F.exp(y))


def clamp_frequency(x: Column, low: float) -> Column:
    """Into [low, 1 - low]; NaN and null become ``low``."""
    return F.greatest(F.least(F.coalesce(F.nanvl(x, F.lit(low)), F.lit(low)), F.lit(1 - low)), F.lit(low))


def variance(x: Column) -> Column:
    return x * (1 - x)


def pivots(start: Column, stop: Column, per_year: int) -> Column:
    """Grid of decimal years from the floor of the start to the ceiling of the stop."""
    first, last = F.floor(start * per_year).cast("int"), F.ceil(stop * per_year).cast("int")
    return F.transform(F.sequence(first, last), lambda i: i / F.lit(float(per_year)))


def pivots_per_year(span: float) -> int:
    return 12 if span < 5 else 6 if span < 10 else 3


def interpolate(points: DataFrame, grid: DataFrame, x: str, y: str, by: list[str], at: str = "at") -> DataFrame:
    """Values of each group's curve at the grid's ``at``: linear between points, end slopes outside.

    Both sides are shuffled once by group: the points around each place are
    found with windows over the union, not with a range join.
    """
    own = Window.partitionBy(*by).orderBy(x)
    segments = points.select(*by, x, y, F.lead(x).over(own).alias("x1"), F.lead(y).over(own).alias("y1"), F.row_number().over(own).alias("k"))
    segments = segments.where("x1 is not null").select(*by, F.when(F.col("k") == 1, F.lit(float("-inf"))).otherwise(F.col(x)).alias("from"), F.struct(x, y, "x1", "y1").alias("s"))
    both = segments.select(*by, F.col("from").alias("_x"), F.lit(0).alias("_q"), "s").unionByName(grid.select(*by, F.col(at).cast("double").alias("_x"), F.lit(1).alias("_q")), allowMissingColumns=True)
    seen = Window.partitionBy(*by).orderBy("_x", "_q").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("s", F.last("s", ignorenulls=True).over(seen)).where("_q = 1")
    value = F.col(f"s.{y}") + (F.col("_x") - F.col(f"s.{x}")) * (F.col("s.y1") - F.col(f"s.{y}")) / (F.col("s.x1") - F.col(f"s.{x}"))
    return out.select(*by, F.col("_x").alias(at), value.alias(y))


def sampling_error(f: Column, n: Column) -> Column:
    """Standard error of a frequency from ``n`` samples, one added."""
    return F.sqrt(f * (1 - f) / (n + 1))
