"""Titer normalisation, reciprocal pairs, sparse designs and regularised antigenic models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from virosight.operators import large_fit
from virosight.operators.solvers import quadratic
from virosight.session import saved

#: Columns, and cells of their normal equations, that a fit collects; larger ones stay distributed.
MAX_COLUMNS, MAX_CELLS = 4_000, 8_000_000


def homologous(titers: DataFrame, least: int = 10) -> DataFrame:
    """``serum, base``: mean log2 of the homologous rows of a serum, else of its largest titer if it has over ``least`` tests; other sera go."""
    own = F.when(F.col("test") == F.col("ref"), F.log2("titer"))
    return titers.groupBy("ref", "serum").agg(F.avg(own).alias("_own"), F.max(F.log2("titer")).alias("_top"), F.count_distinct("test").alias("_n")).select("ref", "serum", F.coalesce("_own", F.when(F.col("_n") > least, F.col("_top"))).alias("base")).where("base is not null")


def normalise(titers: DataFrame, least: int = 10) -> DataFrame:
    """``test, ref, serum, norm, raw, n``: log2 distance below the homologous titer, median raw titer, and count."""
    each = titers.groupBy("test", "ref", "serum").agg(F.avg(F.log2("titer")).alias("_l"), F.median("titer").alias("raw"), F.count("*").alias("n"))
    return each.join(homologous(titers, least), ["ref", "serum"]).select("test", "ref", "serum", (F.col("base") - F.col("_l")).alias("norm"), "raw", "n")


def reciprocal(titers: DataFrame) -> DataFrame:
    """Pairs measured both ways with the difference of their values; each pair once, by an equality join of the table with itself."""
    a = titers.groupBy("test", "ref").agg(F.avg("norm").alias("v"))
    b = a.select(F.col("ref").alias("test"), F.col("test").alias("ref"), F.col("v").alias("w"))
    return a.join(b, ["test", "ref"]).where("test < ref").select("test", "ref", (F.col("v") - F.col("w")).alias("asymmetry"))


def design(titers: DataFrame, effects: DataFrame, row: str = "row_id", kc: float = 0.2) -> DataFrame:
    """Sparse weighted design ``row, col, w``: effect columns of each row, its serum and its virus.

    Rows of sera with many measurements weigh less, by 1 / (1 + kc n), and
    the weight's root goes into the entries.
    """
    n = titers.groupBy("serum").agg(F.count("*").alias("_n"))
    weight = titers.join(n, "serum").select(row, "test", "ref", "serum", F.sqrt(1 / (1 + kc * F.col("_n"))).alias("w"))
    parts = [
        effects.join(weight.select(row, "w"), row).select(row, F.concat(F.lit("effect:"), F.col("effect").cast("string")).alias("col"), "w"),
        weight.where("test <> ref").select(row, F.concat(F.lit("serum:"), F.col("serum").cast("string")).alias("col"), "w"),
        weight.select(row, F.concat(F.lit("virus:"), F.col("test").cast("string")).alias("col"), "w"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def gram(entries: DataFrame, row: str = "row_id") -> DataFrame:
    """Products of columns summed over rows, upper triangle: ``col1, col2, v``."""
    a = entries.select(row, F.col("col").alias("col1"), F.col("w").alias("w1"))
    b = entries.select(row, F.col("col").alias("col2"), F.col("w").alias("w2"))
    return a.join(b, row).where("col1 <= col2").groupBy("col1", "col2").agg(F.sum(F.col("w1") * F.col("w2")).alias("v"))


def moments(entries: DataFrame, target: DataFrame, y: str, row: str = "row_id") -> DataFrame:
    return entries.join(target.select(row, y), row).groupBy("col").agg(F.sum(F.col("w") * F.col(y)).alias("v"))


def collect_equations(entries: DataFrame, target: DataFrame, y: str, row: str = "row_id", cells: DataFrame | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Column names, X'X and -X'y of the design; both sizes are checked before anything is collected."""
    names = [r[0] for r in entries.select("col").distinct().orderBy("col").limit(MAX_COLUMNS + 1).collect()]
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"a design of over {MAX_COLUMNS} columns")
    cells = saved(gram(entries, row)) if cells is None else cells
    if (n := cells.count()) > MAX_CELLS:
        raise ValueError(f"normal equations of {n} cells; at most {MAX_CELLS} are collected")
    seat = {c: i for i, c in enumerate(names)}
    p, q = np.zeros((len(names), len(names))), np.zeros(len(names))
    for a, b, v in cells.toLocalIterator():
        p[seat[a], seat[b]] = p[seat[b], seat[a]] = v
    for c, v in moments(entries, target, y, row).collect():
        q[seat[c]] = -v
    return names, p, q


def fit(
    entries: DataFrame, target: DataFrame, y: str, l1: float = 1.0, l2_serum: float = 3.0, l2_virus: float = 0.3, signed: bool = False, row: str = "row_id"
) -> DataFrame:
    """Effects with an L1 penalty at 0 or above (or signed), sera and viruses with ridge penalties: ``col, value``.

    The normal equations are two distributed aggregations; see ``solved``.
    """

    def penalties(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        genetic = np.array([c.startswith("effect:") for c in names], bool)
        ridge = np.array([0.0 if g else l2_serum if c.startswith("serum:") else l2_virus for c, g in zip(names, genetic, strict=True)])
        return np.where(genetic, l1, 0.0), ridge, genetic & (not signed)

    return solved(entries, target, y, penalties, row)


def solved(entries: DataFrame, target: DataFrame, y: str, penalties, row: str = "row_id") -> DataFrame:
    """``col, value`` of the least penalised squares; ``penalties(names)`` gives L1, ridge and sign of columns.

    Equations of up to ``MAX_COLUMNS`` columns and ``MAX_CELLS`` cells are
    collected and solved by coordinate descent; larger ones stay distributed
    (``large_fit``).  Both end at the same optimum.
    """
    cells = saved(gram(entries, row))
    few = entries.select("col").distinct().limit(MAX_COLUMNS + 1).count() <= MAX_COLUMNS
    if few and cells.count() <= MAX_CELLS:
        names, p, q = collect_equations(entries, target, y, row, cells)
        x = quadratic(p, q, *penalties(names))
        return entries.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(names, x, strict=True)], "col string, value double")
    equations = large_fit.Equations(cells, moments(entries, target, y, row), entries)
    try:
        return large_fit.fitted(equations, penalties)
    finally:
        equations.close()


def predict(entries: DataFrame, model: DataFrame, row: str = "row_id", unweighted: bool = True, cutoff: float = 0.0) -> DataFrame:
    """Summed effects above a cutoff, sera and viruses of each row."""
    used = F.when(F.col("col").startswith("effect:") & (F.col("value") <= cutoff), 0.0).otherwise(F.col("value"))
    return entries.join(model, "col").groupBy(row).agg(F.sum(used if unweighted else used * F.col("w")).alias("predicted"))


def mutation_counts(pairs: DataFrame, mutations: str) -> DataFrame:
    """How many pairs each mutation of an array column separates."""
    return pairs.select(F.explode(mutations).alias("mutation")).groupBy("mutation").agg(F.count("*").alias("n"))


def colinear(entries: DataFrame, most: int = 5, row: str = "row_id") -> DataFrame:
    """Column pairs whose rows differ in ``most`` places at most: ``col1, col2, differ``."""
    each = entries.select(row, "col").distinct()
    size = each.groupBy("col").agg(F.count("*").alias("n"))
    both = each.withColumnRenamed("col", "col1").join(each.withColumnRenamed("col", "col2"), row).where("col1 < col2").groupBy("col1", "col2").agg(F.count("*").alias("k"))
    n = both.join(size.toDF("col1", "n1"), "col1").join(size.toDF("col2", "n2"), "col2")
    return n.select("col1", "col2", (F.col("n1") + F.col("n2") - 2 * F.col("k")).alias("differ")).where(F.col("differ") <= most)


def mean_squared_error(df: DataFrame, y: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg((y - predicted) * (y - predicted)).alias("mse"))
