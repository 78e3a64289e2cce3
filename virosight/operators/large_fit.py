"""Penalised least squares of any number of columns: the normal equations stay distributed, the driver holds vectors.

The cells of X'X are packed once in rows of arrays, dealt by ranges of
columns, and kept by the executors.  A product with a vector is one pass over
them without a shuffle: the vector goes out, each row's sums come back.  The
solver is a projected Newton method: coordinates that are held at zero by
their penalty or sign are left out, the others take a Newton step found by
conjugate gradients, and steps are shortened until the objective falls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from virosight.operators.ordered import running_totals
from virosight.session import saved

#: Columns whose vectors the driver holds (32 MB each), and cells of a packed row.
MAX_VECTOR, PACKED = 4_000_000, 500_000


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, PACKED):
            part = [c.to_numpy() for c in batch.slice(k, PACKED).columns]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in part], names=["i", "j", "v"])


def _product(vector):
    """mapInArrow function over packed rows: the columns met and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i, j, v = np.frombuffer(i, np.int64), np.frombuffer(j, np.int64), np.frombuffer(v, np.float64)
                first = np.flatnonzero(np.diff(i, prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array([i[first].tobytes()], pa.binary()), pa.array([np.add.reduceat(v * vector.value[j], first).tobytes()], pa.binary())], names=["i", "y"])

    return run


class Equations:
    """X'X and -X'y of a design ``row, col, w``: packed cells, the column numbers ``col, id``, and the diagonal."""

    def __init__(self, cells: DataFrame, moments: DataFrame, columns: DataFrame):
        spark = cells.sparkSession
        seats = running_totals(columns.select("col").distinct().withColumn("_one", F.lit(1).cast("long")), ["col"], {"id": "_one"})
        self.columns = saved(seats.select("col", (F.col("id") - 1).alias("id")))
        self.size = self.columns.count()
        if self.size > MAX_VECTOR:
            raise ValueError(f"vectors of over {MAX_VECTOR} columns")
        known = cells.join(self.columns.toDF("col1", "i"), "col1").join(self.columns.toDF("col2", "j"), "col2").select("i", "j", F.col("v").cast("double").alias("v"))
        both = saved(known.unionByName(known.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v")))
        parts = max(spark.sparkContext.defaultParallelism, both.count() // (4 * PACKED))
        packed = both.repartitionByRange(parts, "i").sortWithinPartitions("i").mapInArrow(_packer, "i binary, j binary, v binary")
        self.packed = saved(packed).persist(StorageLevel.MEMORY_AND_DISK)
        vector = lambda df: self._filled(df.select("id", "v").toPandas())
        self.diagonal = vector(both.where("i = j").select(F.col("i").alias("id"), "v"))
        self.q = -vector(moments.join(self.columns, "col").select("id", F.col("v").cast("double").alias("v")))

    def _filled(self, rows) -> np.ndarray:
        out = np.zeros(self.size)
        out[rows["id"].to_numpy(np.int64)] = rows["v"].to_numpy(float)
        return out

    def times(self, x: np.ndarray) -> np.ndarray:
        """X'X x."""
        context = self.packed.sparkSession.sparkContext
        sent = context.broadcast(x)
        out = np.zeros(self.size)
        for i, y in self.packed.mapInArrow(_product(sent), "i binary, y binary").collect():
            np.add.at(out, np.frombuffer(i, np.int64), np.frombuffer(y, np.float64))
        sent.destroy()
        return out

    def close(self) -> None:
        self.packed.unpersist()


def _conjugate(times: Callable, b: np.ndarray, scale: np.ndarray, tol: float, rounds: int) -> np.ndarray:
    """Solution of A x = b by conjugate gradients, scaled by A's diagonal."""
    x, r = np.zeros(len(b)), b.copy()
    z = r / scale
    p, rz = z.copy(), float(r @ z)
    for _ in range(rounds):
        if np.sqrt(r @ r) <= tol or rz <= 0:
            break
        ap = times(p)
        curve = float(p @ ap)
        if curve <= 1e-300:
            break
        step = rz / curve
        x, r = x + step * p, r - step * ap
        z = r / scale
        new = float(r @ z)
        p, rz = z + new / rz * p, new
    return x


def solve(times: Callable, q: np.ndarray, diagonal: np.ndarray, l1: np.ndarray, l2: np.ndarray, positive: np.ndarray, tol: float = 1e-7, rounds: int = 100) -> np.ndarray:
    """Least of x'Px/2 + q'x + sum l1|x| + sum l2 x^2 / 2, ``positive`` coordinates at 0 or above; ``times`` gives P x.

    Ends when no first-order condition is violated by more than ``tol``, or
    when steps no longer lower the objective.
    """
    n = len(q)
    x, px = np.zeros(n), np.zeros(n)
    scale = np.maximum(diagonal + l2, 1e-12)
    held = positive | (l1 > 0)
    cost = lambda x, px: float(x @ px / 2 + q @ x + l1 @ np.abs(x) + l2 @ (x * x) / 2)
    now = 0.0
    for _ in range(rounds):
        g = px + q + l2 * x
        # The side that a coordinate is on, or would move to from zero.
        side = np.where(positive, 1.0, np.where(x != 0, np.sign(x), -np.sign(g)))
        slope = g + l1 * side
        at_zero = held & (x == 0) & np.where(positive, slope >= 0, np.abs(g) <= l1)
        slope[at_zero] = 0.0
        worst = np.abs(slope).max(initial=0.0)
        if worst <= tol:
            break
        free = ~at_zero

        def reduced(p, free=free):
            return np.where(free, times(p) + l2 * p, 0.0)

        d = _conjugate(reduced, -slope, scale, max(min(0.05, worst) * float(np.sqrt(slope @ slope)), tol / 10), 200)
        step, moved = 1.0, False
        while step > 1e-6:
            y = x + step * d
            # A coordinate stops at zero instead of changing its side.
            y = np.where(held & free & (y * side < 0), 0.0, y)
            py = times(y)
            if (value := cost(y, py)) < now - 1e-15 * abs(now):
                moved = True
                break
            step /= 4
        if not moved:
            # Where the projection spoils the step, each coordinate moves for itself, held short enough for all.
            y = x - slope / (4 * scale)
            y = np.where(held & free & (y * side < 0), 0.0, y)
            py = times(y)
            if (value := cost(y, py)) >= now:
                break
        x, px, now = y, py, value
    return x


def first_order_gap(times: Callable, q, l1, l2, positive, x) -> float:
    """Largest violation of the first-order conditions."""
    g = times(x) + q + l2 * x
    zero = np.where(positive, np.maximum(-(g + l1), 0), np.maximum(np.abs(g) - l1, 0))
    return float(np.where(x == 0, zero, np.abs(g + l1 * np.sign(x))).max(initial=0.0))


def fitted(equations: Equations, penalties: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """``col, value`` of a fit; ``penalties`` gives L1, ridge and sign of columns from their names, asked block by block."""
    spark = equations.columns.sparkSession
    l1, l2, positive = np.zeros(equations.size), np.zeros(equations.size), np.zeros(equations.size, bool)
    names: list[tuple[int, str]] = []

    def fill():
        at = np.array([i for i, _ in names], np.int64)
        l1[at], l2[at], positive[at] = penalties([c for _, c in names])
        names.clear()

    for col, i in equations.columns.toLocalIterator():
        names.append((i, col))
        if len(names) >= 100_000:
            fill()
    if names:
        fill()
    x = solve(equations.times, equations.q, equations.diagonal, l1, l2, positive)
    import pandas as pd

    values = spark.createDataFrame(pd.DataFrame({"id": np.arange(equations.size), "value": x}), "id long, value double")
    return saved(equations.columns.join(values, "id").select("col", "value"))
