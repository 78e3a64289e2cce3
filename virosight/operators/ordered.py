"""Running totals, ranks and quantiles over one global order, without a task that sees all rows.

Rows are dealt to ranges of the order; each range adds up its own rows, and
the sums of the ranges before it (one figure a partition) are added to them.
"""

from __future__ import annotations

from decimal import Decimal
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType

from virosight.session import saved

#: Rows of a block in a running window over one long order.
BLOCK = 100_000


def running_totals(df: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """Adds, for each ``out: value`` column, the sum over the rows up to and including this one.

    Rows that are equal in ``order`` come in no given order among each other.
    """
    ranged = saved(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = {v: F.sum(v).alias(f"_s{i}") for i, v in enumerate(dict.fromkeys(values.values()))}
    parts = sorted(ranged.groupBy("_range").agg(*sums.values()).collect())
    # One row a partition: what the ranges before it add up to.
    kinds = ranged.groupBy("_range").agg(*sums.values()).schema
    zeros = [Decimal(0) if isinstance(f.dataType, DecimalType) else 0.0 if isinstance(f.dataType, DoubleType) else 0 for f in kinds.fields]
    columns = [[*accumulate((r[k] or zeros[k] for r in parts), initial=zeros[k])][:-1] for k in range(1, len(sums) + 1)]
    before = df.sparkSession.createDataFrame([(r[0], *c) for r, c in zip(parts, zip(*columns, strict=True), strict=True)], kinds)
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seat = {v: f"_s{i}" for i, v in enumerate(sums)}
    out = ranged.join(F.broadcast(before), "_range")
    return out.withColumns({o: F.sum(v).over(own) + F.col(seat[v]) for o, v in values.items()}).drop("_range", *seat.values())


def value_counts(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``by, value, n, before``: rows with each value, and rows of the group with a lesser one; nulls take no part."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    total = running_totals(counts, [*by, value], {"_upto": "n"}).withColumn("before", F.col("_upto") - F.col("n")).drop("_upto")
    if not by:
        return total
    total = saved(total)
    first = total.groupBy(*by).agg(F.min("before").alias("_first"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    joined = total.alias("l").join(first.alias("r"), same)
    return joined.select(*(f"l.{c}" for c in by), f"l.{value}", "l.n", (F.col("l.before") - F.col("r._first")).alias("before"))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbours; None for each if there is no value."""
    counts = saved(value_counts(df, value))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return [None] * len(shares)
    places = {s: s * (total - 1) for s in shares}
    wanted = sorted({k for p in places.values() for k in (int(p), min(int(p) + 1, total - 1))})
    seats = F.explode(F.filter(F.array(*(F.lit(k) for k in wanted)), lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n"))))
    found = {r["k"]: float(r["v"]) for r in counts.select(seats.alias("k"), F.col(value).alias("v")).collect()}
    low = {s: (found[int(p)], found[min(int(p) + 1, total - 1)], p - int(p)) for s, p in places.items()}
    return [a + (b - a) * w for a, b, w in (low[s] for s in shares)]


def blocks_with_edges(df: DataFrame, order: list[str], before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Adds ``_block`` and ``_own``: rows in blocks of one order, each with the ``before`` and ``after`` rows around it.

    A running window of that reach, partitioned by the block, gives the same
    as over all rows at once where ``_own`` holds.
    """
    rows = running_totals(df.withColumn("_one", F.lit(1).cast("long")), order, {"_place": "_one"}).drop("_one")
    k = F.col("_place") - 1
    low, high = F.greatest(F.floor((k - after) / block), F.lit(0)), F.floor((k + before) / block)
    seats = rows.withColumn("_block", F.explode(F.sequence(low, high)))
    return seats.withColumn("_own", F.col("_block") == F.floor((F.col("_place") - 1) / block)).drop("_place")
