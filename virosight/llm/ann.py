"""Approximate nearest neighbours by cosine with a permutation index.

A vector is stood for by its ``PREFIX`` nearest of ``PIVOTS`` pivots, in order.
Vectors are posted in the inverted file of the cell (one of the first pivots)
that is nearest to them; a file is cut in parts of about ``PART_ROWS`` rows.
Within a part each pivot has a file of the places it takes in the part's
vectors.  A query visits the files of its own nearest cells alone, adds up over
its own pivots' files how near the places are, which ranks the vectors by the
footrule distance of the orders, and reranks the best with the exact measure.

Pivots come from a bounded sample of distinct vectors.  On the same sample,
exact neighbours tell how many cells a query has to visit and which share of a
part it has to rerank (``REACH`` of the neighbours are met by each).  Every
vector is indexed.  Equal vectors of a part are indexed once, with their least
ids, so one very common vector can't crowd out others.  Vectors of each length
are searched among their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from virosight.llm.text import scratch, written

PIVOTS, PREFIX, PART_ROWS = 256, 64, 4096
#: Vectors, and their components, of the sample of one length; and sample vectors whose neighbours are looked up in it.
SAMPLE_ROWS, SAMPLE_VALUES, SAMPLE_QUERIES = 4096, 1 << 21, 256
#: Lengths of vectors that have a sample: the most common ones.  Vectors of any other length are one file, reranked in full.
LENGTHS = 16
#: Share of the sample's neighbours that must lie in visited cells, and that must be reranked.
REACH = 0.985
#: Vectors of a part that are reranked at least.
CANDIDATES = 64


def _usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _prefixes(unit: np.ndarray, pivots: np.ndarray, size: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    return np.argsort(-(unit @ pivots.T), 1, kind="stable")[:, :size]


def _weights(prefixes: np.ndarray, pivots: int) -> np.ndarray:
    """Vectors x pivots: the prefix's length less the pivot's place in it, 0 for pivots outside."""
    size = prefixes.shape[1]
    out = np.zeros((len(prefixes), pivots), np.uint8)
    np.put_along_axis(out, prefixes, np.arange(size, 0, -1, dtype=np.uint8)[None, :], 1)
    return out


def _nearness(files: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Nearness of one order to all orders of the files (pivots x vectors): falls as the footrule distance grows.

    Two weights' difference is their sum less twice the lesser one, and the
    sums are the same for all orders, so the summed lesser weights rank.
    """
    own = np.arange(len(prefix), 0, -1, dtype=np.uint8)[:, None]
    return np.minimum(files[prefix], own).sum(0, dtype=np.uint16)


class Fit(NamedTuple):
    """Index of the vectors of one length: pivots (the first ``cells`` of them head the inverted files), cells to visit, share to rerank."""

    pivots: np.ndarray
    cells: int
    visits: int
    share: float


def fit(sample: np.ndarray, total: int, k: int) -> Fit:
    """Pivots, and bounds that keep ``REACH`` of the exact neighbours within the sample, which lie further off than in the whole table."""
    unit = _unit(sample)
    pivots = unit[:PIVOTS]
    cells = int(min(len(pivots), max(1, round(total / PART_ROWS))))
    if len(unit) <= 2 * CANDIDATES:
        return Fit(pivots, cells, cells, 1.0)
    queries = np.arange(len(unit))[:: max(1, len(unit) // SAMPLE_QUERIES)]
    cosine = unit[queries] @ unit.T
    cosine[np.arange(len(queries)), queries] = -2
    top = np.argpartition(-cosine, k, 1)[:, :k]
    order = np.argsort(np.argsort(-(unit[queries] @ pivots[:cells].T), 1, kind="stable"), 1)
    home = (unit @ pivots[:cells].T).argmax(1)
    visits = int(np.quantile(np.take_along_axis(order, home[top], 1), REACH, method="higher")) + 1
    prefixes = _prefixes(unit, pivots, min(PREFIX, len(pivots)))
    files = np.ascontiguousarray(_weights(prefixes, len(pivots)).T)
    place = []
    for q, own in zip(queries, top, strict=True):
        near = _nearness(files, prefixes[q]).astype(np.int64)
        near[q] = -1
        place.append((near[None, :] > near[own][:, None]).sum(1) / len(unit))
    return Fit(pivots, cells, visits, float(np.quantile(place, REACH, method="higher")) + 1 / len(unit))


def _fit_of(fits, d: int) -> Fit:
    """The fit of a length, or one file that is reranked in full."""
    return fits.value.get(d) or Fit(np.full((1, d), d**-0.5), 1, 1, 1.0)


class Part:
    """The pivots' files of one part of the index."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, index: Fit, k: int):
        order = np.argsort(ids, kind="stable")
        vectors, first, which = np.unique(vectors[order], axis=0, return_index=True, return_inverse=True)
        rank = np.argsort(first, kind="stable")
        self.vectors = vectors[rank]
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        # The k + 1 least ids of each vector: no more can be among a query's nearest.
        self.ids: list[list[int]] = [[] for _ in rank]
        for i, v in zip(ids[order].tolist(), place[which.reshape(-1)].tolist(), strict=True):
            if len(self.ids[v]) <= k:
                self.ids[v].append(i)
        # A query's own row is left out once; rows that repeat its id are others.
        self.rows = set(zip(ids[order].tolist(), place[which.reshape(-1)].tolist(), strict=True))
        self.unit, self.index = _unit(self.vectors), index
        self.size = min(PREFIX, len(index.pivots))
        self.files = np.ascontiguousarray(_weights(_prefixes(self.unit, index.pivots, self.size), len(index.pivots)).T)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        unit = _unit(queries)
        many = min(len(self.vectors), max(CANDIDATES, int(np.ceil(self.index.share * len(self.vectors)))))
        for query, vector, u, prefix in zip(query_ids.tolist(), queries, unit, _prefixes(unit, self.index.pivots, self.size), strict=True):
            best = np.arange(len(self.vectors))
            if many < len(best):
                best = np.sort(np.argpartition(-_nearness(self.files, prefix).astype(np.int32), many - 1)[:many])
            score = np.clip((self.unit[best] * u).sum(1), -1.0, 1.0)
            if len(best) > 2 * k + 2:
                # Equal scores stay together, so that ties go to the smaller id.
                best = best[keep := score >= np.partition(score, len(score) - k - 1)[-k - 1]]
                score = score[keep]
            found = []
            for s, v in zip(score.tolist(), best.tolist(), strict=True):
                own = list(self.ids[v])
                if query in own and (query, v) in self.rows and (self.vectors[v] == vector).all():
                    own.remove(query)
                found += [(-s, i) for i in own]
            for s, i in sorted(found)[:k]:
                yield query, i, -s


def _assigner(fits):
    """mapInArrow function: ``id, v, q, d, cell``, the cell being the nearest cell pivot's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            cell = np.zeros(len(sizes), np.int32)
            for d in np.unique(sizes).tolist():
                at, index = np.flatnonzero(sizes == d), _fit_of(fits, d)
                x = batch.column(1).take(pa.array(at)).flatten().to_numpy().reshape(len(at), d)
                cell[at] = (_unit(x) @ index.pivots[: index.cells].T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["id", "v", "q", "d", "cell"])

    return run


def _visitor(fits):
    """mapInArrow function over query rows: one row ``id, v, q, d, cell`` for each cell that the query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            for d in np.unique(sizes).tolist():
                at, index = np.flatnonzero(sizes == d), _fit_of(fits, d)
                for some in np.array_split(at, max(1, len(at) // 64)):
                    x = batch.column(1).take(pa.array(some)).flatten().to_numpy().reshape(len(some), d)
                    near = _prefixes(_unit(x), index.pivots[: index.cells], index.visits)
                    rows = batch.take(pa.array(np.repeat(some, near.shape[1])))
                    yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(near.reshape(-1).astype(np.int32))], names=["id", "v", "q", "d", "cell"])

    return run


def _searcher(fits, k: int):
    """mapInArrow function over rows sorted by part, vectors before queries: ``query_id, vec_id, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, index = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            edges = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), keys.shape[1]]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                d, cell, part, is_query = keys[:, start].tolist()
                if (d, cell, part) != now:
                    now, ids, vectors, index = (d, cell, part), [], [], None
                own = batch.column(4).slice(start, end - start).to_numpy()
                rows = batch.column(5).slice(start, end - start).flatten().to_numpy().reshape(end - start, d)
                if not is_query:
                    ids.append(own)
                    vectors.append(rows)
                    continue
                if index is None and ids:
                    index = Part(np.concatenate(ids), np.concatenate(vectors), _fit_of(fits, d), k)
                out = list(index.search(own, rows, k)) if index else []
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of every row for which ``is_query`` holds: ``query_id, rank, vec_id, score``.

    ``score`` is the cosine of the original vectors in double precision; ties
    go to the smaller id.  A query's own row is left out once: other rows are
    candidates even if they repeat its id or vector, and two query rows of one
    id share one answer.  Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without an id, take no part; neighbours
    have the query's length.  No usable vector gives no row.  Other columns
    are not read.
    """
    with scratch():
        spark = vectors.sparkSession
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & _usable(F.col("v"))).withColumn("d", F.size("v"))
        totals = dict(rows.groupBy("d").count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect())
        # The sample: distinct vectors drawn by a hash of their components.
        draw = F.pmod(F.xxhash64("v"), F.lit(1 << 40)) / float(1 << 40)
        share = lambda d, n: min(1.0, 1.5 * min(SAMPLE_ROWS, max(1, SAMPLE_VALUES // len(totals) // d)) / n)
        rate = F.element_at(F.create_map(*(F.lit(x) for d, n in totals.items() for x in (d, share(d, n)))), F.col("d")) if totals else F.lit(0.0)
        drawn = rows.where(draw < rate).groupBy("d", F.xxhash64("v").alias("h")).agg(F.first("v").alias("v"))
        seat = F.row_number().over(Window.partitionBy("d").orderBy("h"))
        bound = F.least(F.lit(SAMPLE_ROWS), F.greatest(F.lit(1), F.floor(F.lit(SAMPLE_VALUES // max(1, len(totals))) / F.col("d"))))
        sample: dict[int, list] = {}
        for r in drawn.withColumn("_k", seat).where(F.col("_k") <= bound).orderBy("d", "h").select("d", "v").toLocalIterator():
            sample.setdefault(r["d"], []).append(r["v"])
        fits = spark.sparkContext.broadcast({d: fit(np.array(x), totals[d], k) for d, x in sample.items()})
        shape = "id long, v array<double>, q boolean, d int, cell int"
        index = written(rows.mapInArrow(_assigner(fits), shape))
        parts = written(index.groupBy("d", "cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")))
        posted = index.join(parts, ["d", "cell"]).select("d", "cell", F.pmod(F.xxhash64("id", "v"), "parts").cast("int").alias("part"), F.lit(0).alias("is_query"), "id", "v")
        asked = index.where("q").select("id", "v", "q", "d").dropDuplicates(["id", "v"]).mapInArrow(_visitor(fits), shape)
        asked = asked.join(parts, ["d", "cell"]).select("d", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("is_query"), "id", "v")
        order = ["d", "cell", "part"]
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(parts.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]))
        found = posted.unionByName(asked).repartition(tasks, *order).sortWithinPartitions(*order, "is_query").mapInArrow(_searcher(fits, k), "query_id long, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return written(found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k), keep=True)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every row of ``embeddings`` whose id is divisible by 50; odd rows as in ``nearest``."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
