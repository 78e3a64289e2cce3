"""Hard negatives by inner product: cover trees over norm-augmented vectors, searched by windows of scores.

A vector x gets one more component, so that all have the norm of the longest;
a query gets a zero there.  Then x . q falls as the distance of the two grows,
and a ball around a centre bounds the inner products of all that it covers
from above and from below.

Vectors are dealt to cells around centres drawn from a bounded sample, the top
level of the tree, and a cell is cut in parts of about ``PART_ROWS`` rows.  In
each part a cover tree is built: the children's centres of a node are chosen
farthest first, up to ``FAN`` of them, until they cover it by half its radius,
and every node keeps the radius it really covers.  A query visits the cells
that can hold scores within its window; within a part its bounds go down level
by level, and leaves are verified with exact integers, best bound first, until
no leaf can better the last of its ``k`` best.

Positives are searched with a window that is open above and starts at the
sample's bound for the last positive, negatives with a window for each
positive.  Bounds only skip what can't count, so results are exact for every
sample, tree and part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from virosight.llm.text import scratch, slices, written

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256.0
#: Rows, and their components, of a part; rows of a leaf; children of a node; query rows searched at once.
PART_ROWS, PART_VALUES, LEAF, FAN, QUERIES = 4096, 1 << 19, 64, 32, 512
#: Vectors and components of the sample of one length, centres of cells, and lengths that have a sample.
SAMPLE_ROWS, SAMPLE_VALUES, CELLS, LENGTHS = 4096, 1 << 21, 256, 16
#: Largest size of a scaled component: products of vectors of 2 ** 10 such stay within 64 bits.
LARGEST = float(1 << 26)

_NEVER, _ALWAYS = -(1 << 62), 1 << 62


class Tree:
    """Cover tree of the vectors of one part (rows of whole numbers as doubles)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        norms = (vectors * vectors).sum(1)
        self.longest = float(norms.max())
        points = np.concatenate([vectors, np.sqrt(np.maximum(self.longest - norms, 0))[:, None]], 1)
        order = np.arange(len(ids))
        #: For each level: the nodes' centres (row of the part), covering radii, parents (place in the level above), and which are leaves with their rows.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.leaves: list[tuple[int, int, int, int]] = []
        open_nodes = [(0, len(ids), 0, -1)]
        while open_nodes:
            centres, radii, parents, below = [], [], [], []
            for low, high, centre, parent in open_nodes:
                rows = order[low:high]
                apart = np.sqrt(((points[rows] - points[centre]) ** 2).sum(1))
                place = len(centres)
                centres.append(centre)
                radii.append(float(apart.max()))
                parents.append(parent)
                if high - low <= LEAF or radii[-1] == 0:
                    self.leaves.append((len(self.levels), place, low, high))
                    continue
                nearest, home, own = apart, np.zeros(len(rows), np.int64), [centre]
                while len(own) < FAN and nearest.max() > radii[-1] / 2:
                    own.append(int(rows[nearest.argmax()]))
                    d = np.sqrt(((points[rows] - points[own[-1]]) ** 2).sum(1))
                    home[d < nearest] = len(own) - 1
                    nearest = np.minimum(nearest, d)
                seat = np.argsort(home, kind="stable")
                order[low:high] = rows[seat]
                ends = low + np.searchsorted(home[seat], np.arange(len(own) + 1))
                below += [(a, b, c, place) for c, a, b in zip(own, ends[:-1].tolist(), ends[1:].tolist(), strict=True) if b > a]
            self.levels.append((vectors[centres], np.array(radii), np.array(parents)))
            open_nodes = below
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.largest = float(np.abs(vectors).max(initial=0))

    def bounds(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Best score within its window that each leaf can hold for each query; minus infinity where it holds none."""
        total = (queries * queries).sum(1)[:, None] + self.longest
        slack = 1e-6 * total
        tops: list[np.ndarray] = []
        for centres, radii, parents in self.levels:
            apart = np.sqrt(np.maximum(total - 2 * (queries @ centres.T), 0))
            above = (total - np.maximum(apart - radii, 0) ** 2) / 2 + slack
            least = (total - (apart + radii) ** 2) / 2 - slack
            top = np.where((above >= low[:, None]) & (least <= high[:, None]), np.minimum(above, high[:, None]), -np.inf)
            tops.append(np.minimum(top, tops[-1][:, parents]) if tops else top)
        return np.stack([tops[level][:, place] for level, place, _, _ in self.leaves], 1)

    def scores(self, queries: np.ndarray, low: int, high: int) -> np.ndarray:
        """Exact inner products with the rows of a leaf."""
        rows = self.vectors[low:high]
        if self.largest * np.abs(queries).max(initial=0) * rows.shape[1] < 1 << 53:
            return (queries @ rows.T).astype(np.int64)
        return queries.astype(np.int64) @ rows.T.astype(np.int64)

    def search(self, queries: np.ndarray, allowed, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``k`` best rows of each query within its window: query, row and score.

        ``allowed(query places, row slice)`` tells which rows count.  Each
        round verifies twice as many leaves of a query, best bound first.
        """
        bounds = self.bounds(queries, low.astype(float), high.astype(float))
        ranked = np.argsort(-bounds, 1, kind="stable")
        bounds = np.take_along_axis(bounds, ranked, 1)
        last = np.full(len(queries), _NEVER)
        best = (np.empty(0, np.int64),) * 3
        start, step = 0, 1
        while start < ranked.shape[1]:
            wanted = bounds[:, start : start + step] >= np.maximum(last, _NEVER + 1)[:, None]
            asks, leaf = np.nonzero(wanted)
            if not len(asks):
                break
            leaf = ranked[asks, start + leaf]
            order = np.argsort(leaf, kind="stable")
            asks, leaf = asks[order], leaf[order]
            found = [best]
            for some in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1):
                _, _, a, b = self.leaves[leaf[some[0]]]
                own = asks[some]
                score = self.scores(queries[own], a, b)
                i, j = np.nonzero((score >= np.maximum(low[own], last[own])[:, None]) & (score <= high[own][:, None]) & allowed(own, slice(a, b)))
                found.append((own[i], a + j, score[i, j]))
            query, row, score = (np.concatenate([x[c] for x in found]) for c in range(3))
            order = np.lexsort((self.ids[row], -score, query))
            query, row, score = query[order], row[order], score[order]
            seat = np.arange(len(query)) - np.searchsorted(query, query)
            keep = seat < k
            full = seat == k - 1
            last[query[full]] = score[full]
            best = query[keep], row[keep], score[keep]
            start, step = start + step, 2 * step
        return best


class Cells(NamedTuple):
    """Top level for vectors of one length: norm that all are brought to, centres, and the sample that they come from."""

    longest: float
    centres: np.ndarray
    sample: np.ndarray
    labels: np.ndarray
    ids: np.ndarray


def _apart(vectors: np.ndarray, cells: Cells) -> np.ndarray:
    """Distances of augmented vectors to the augmented centres."""
    extra = lambda x: np.sqrt(np.maximum(cells.longest - (x * x).sum(1), 0))
    a, b = extra(vectors), extra(cells.centres)
    square = (vectors * vectors).sum(1)[:, None] + (cells.centres * cells.centres).sum(1) - 2 * (vectors @ cells.centres.T) + (a[:, None] - b) ** 2
    return np.sqrt(np.maximum(square, 0))


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), d)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column("d").to_numpy()
    for d in np.unique(sizes).tolist():
        yield d, batch.take(pa.array(np.flatnonzero(sizes == d)))


def _assigner(fits):
    """mapInArrow function: adds the nearest centre's number and the distance to it; one cell without a bound where the length has no sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            for d, rows in _by_length(batch):
                cell, far = np.zeros(rows.num_rows, np.int32), np.full(rows.num_rows, np.inf)
                if d in fits.value:
                    apart = _apart(_matrix(rows.column("v"), d), fits.value[d])
                    cell, far = apart.argmin(1).astype(np.int32), apart.min(1)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell), pa.array(far)], names=[*rows.schema.names, "cell", "far"])

    return run


class Ask(NamedTuple):
    """What a search looks for: ``k`` rows of the query's own label, or of others within shares (hundredths) of given scores."""

    positive: bool
    k: int
    low: int = 0
    high: int = 0

    def windows(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest whole score of each window."""
        if self.positive:
            return scores, np.full(len(scores), _ALWAYS)
        return -((-self.low * scores) // 100), (self.high * scores) // 100


def _windows_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Owner row and score of every entry of a column of lists of (place, id, score)."""
    counts = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), counts), column.flatten().field("score").to_numpy()


def _sample_bound(cells: Cells, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Score that the k-th best row of the own label has at least, from the sample's rows."""
    if len(cells.sample) < k:
        return np.full(len(ids), _NEVER + 1)
    own = (cells.labels == labels[:, None]) & (cells.ids != ids[:, None])
    scores = np.where(own, vectors @ cells.sample.T, -np.inf)
    kth = np.partition(scores, len(cells.sample) - k, 1)[:, -k]
    # A score beyond exact doubles may be rounded up.
    return np.where(np.isfinite(kth), np.floor(kth - np.abs(kth) * 1e-9), _NEVER + 1.0).astype(np.int64)


def _visitor(fits, radii: dict[tuple[int, int], float], ask: Ask):
    """mapInArrow function over queries: a row for each cell that can hold scores of one of its windows; positives get their window from the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, QUERIES):
            for d, rows in _by_length(batch):
                cells = fits.value.get(d)
                v, wins = _matrix(rows.column("v"), d), rows.column("wins")
                owner, score = _windows_of(wins)
                if ask.positive and cells:
                    score = _sample_bound(cells, rows.column("id").to_numpy(), rows.column("label").to_numpy(), v, ask.k)[owner]
                # Made anew in any case, so that all batches have one schema.
                fields = [wins.flatten().field(0), wins.flatten().field(1), pa.array(score)]
                wins = pa.ListArray.from_arrays(wins.offsets, pa.StructArray.from_arrays(fields, names=["place", "other", "score"]))
                low, high = ask.windows(score)
                if cells:
                    total = (v * v).sum(1)[:, None] + cells.longest
                    apart = np.sqrt(np.maximum(total - 2 * (v @ cells.centres.T), 0))
                    radius = np.array([radii.get((d, c), 0.0) for c in range(len(cells.centres))])
                    slack = 1e-6 * total
                    most, least = (total - np.maximum(apart - radius, 0) ** 2) / 2 + slack, (total - (apart + radius) ** 2) / 2 - slack
                    hits = (most[owner] >= low[:, None]) & (least[owner] <= high[:, None])
                    visits = np.zeros(apart.shape, bool)
                    np.logical_or.at(visits, owner, hits)
                    at, cell = np.nonzero(visits)
                else:
                    at, cell = np.arange(len(v)), np.zeros(len(v), np.int64)
                kept = pa.RecordBatch.from_arrays([wins if n == "wins" else c for n, c in zip(rows.schema.names, rows.columns, strict=True)], names=rows.schema.names).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell.astype(np.int32))], names=[*rows.schema.names, "cell"])

    return run


def _searcher(ask: Ask):
    """mapInArrow function over rows sorted by part, vectors before queries: ``anchor_id, place, other, score, found_id, found_score``."""

    def found(tree: Tree, rows: pa.RecordBatch, d: int) -> pa.RecordBatch:
        owner, score = _windows_of(rows.column("wins"))
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()

        def allowed(queries, part):
            same = tree.labels[part] == labels[owner[queries], None]
            return same & (tree.ids[part] != ids[owner[queries], None]) if ask.positive else ~same

        low, high = ask.windows(score)
        query, row, value = tree.search(_matrix(rows.column("v"), d)[owner], allowed, low, high, ask.k)
        wins = rows.column("wins").flatten().take(pa.array(query))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[owner[query]]), wins.field("place"), wins.field("other"), wins.field("score"), pa.array(tree.ids[row]), pa.array(value)],
            names=["anchor_id", "place", "other", "score", "found_id", "found_score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in ("d", "cell", "part", "is_query")])
            edges = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), keys.shape[1]]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                *part, is_query = keys[:, start].tolist()
                if part != now:
                    now, held, tree = part, [], None
                if not is_query:
                    rows = batch.slice(start, end - start)
                    held.append((rows.column("id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("v"), part[0])))
                    continue
                if tree is None and held:
                    tree, held = Tree(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                if tree:
                    for k in range(start, end, QUERIES):
                        yield found(tree, batch.slice(k, min(QUERIES, end - k)), part[0])

    return run


_WINS = "array<struct<place: int, other: bigint, score: bigint>>"


def _searched(index: DataFrame, parts: DataFrame, queries: DataFrame, fits, radii: dict, ask: Ask, tasks: int) -> DataFrame:
    """Best rows of each window over all parts: ``anchor_id, place, other, score, rank, found_id, found_score``."""
    shape = f"id long, label long, v array<double>, d int, wins {_WINS}"
    asked = queries.select("id", "label", "v", "d", "wins").mapInArrow(_visitor(fits, radii, ask), f"{shape}, cell int").join(parts, ["d", "cell"])
    asked = asked.select("d", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("is_query"), "id", "label", "v", "wins")
    posted = index.join(parts, ["d", "cell"]).select("d", "cell", F.pmod(F.xxhash64("id", "v"), "parts").cast("int").alias("part"), F.lit(0).alias("is_query"), "id", "label", "v", F.lit(None).cast(_WINS).alias("wins"))
    order = ["d", "cell", "part"]
    dealt = posted.unionByName(asked).repartition(tasks, *order).sortWithinPartitions(*order, "is_query")
    found = dealt.mapInArrow(_searcher(ask), "anchor_id long, place int, other long, score long, found_id long, found_score long")
    # Each part gives k rows a window at most.
    own = Window.partitionBy("anchor_id", "place").orderBy(F.desc("found_score"), "found_id")
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= ask.k)


def _usable(vector: Column, scale: float) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) <= LARGEST))


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE) -> DataFrame:
    """Hard negatives of every anchor: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Each component becomes ``floor(scale * x)`` and scores are integer inner
    products.  An anchor's positives are its ``positives`` best other rows of
    its label (all, if fewer; another row is one with another id); for each,
    the ``negatives`` best rows of other labels whose score lies within
    ``low`` to ``high`` hundredths of the positive's.  Ties go to the smaller
    id.  A positive of negative score has an empty window.  Rows with a null
    id, label or vector, an empty vector, or a component that is null, not
    finite or beyond ``LARGEST`` after scaling take no part; vectors are
    compared with those of their length.  Repeated rows are candidates each;
    anchors of one id count once (least label and vector).  No anchor gives no
    row.  Other columns are not read.  Ids and labels are whole numbers.
    """
    with scratch():
        spark = vectors.sparkSession
        narrow = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
        known = narrow.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("v"), scale)).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double"))).withColumn("d", F.size("v"))
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        totals = {r["d"]: r for r in known.groupBy("d").agg(F.count("*").alias("n"), F.max(norm).alias("longest")).orderBy(F.desc("n"), "d").limit(LENGTHS).collect()}
        draw = F.pmod(F.xxhash64("v"), F.lit(1 << 40)) / float(1 << 40)
        share = lambda d, n: min(1.0, 1.5 * min(SAMPLE_ROWS, max(1, SAMPLE_VALUES // d // len(totals))) / n)
        rate = F.element_at(F.create_map(*(F.lit(x) for d, r in totals.items() for x in (d, share(d, r["n"])))), F.col("d")) if totals else F.lit(0.0)
        drawn = known.where(draw < rate).groupBy("d", F.xxhash64("v").alias("h")).agg(F.min(F.struct("id", "label", "v")).alias("r"))
        seat = F.row_number().over(Window.partitionBy("d").orderBy("h"))
        bound = F.least(F.lit(SAMPLE_ROWS), F.greatest(F.lit(1), F.floor(F.lit(SAMPLE_VALUES) / F.col("d") / max(1, len(totals)))))
        sample: dict[int, list] = {}
        for r in drawn.withColumn("_k", seat).where(F.col("_k") <= bound).orderBy("d", "h").select("d", "r.*").toLocalIterator():
            sample.setdefault(r["d"], []).append(r)
        fits = {}
        for d, rows in sample.items():
            x = np.array([r["v"] for r in rows])
            count = int(min(CELLS, len(x), max(1, round(totals[d]["n"] / _part_rows(d)))))
            fits[d] = Cells(totals[d]["longest"], x[:count], x, np.array([r["label"] for r in rows]), np.array([r["id"] for r in rows]))
        shared = spark.sparkContext.broadcast(fits)
        index = written(known.mapInArrow(_assigner(shared), "id long, label long, v array<double>, anchor boolean, d int, cell int, far double"))
        sizes = written(index.groupBy("d", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")))
        radii = {(r["d"], r["cell"]): r["far"] for r in sizes.where(F.col("d").isin(*fits)).collect()} if fits else {}
        each = F.least(F.lit(PART_ROWS), F.greatest(F.lit(LEAF), F.floor(F.lit(PART_VALUES) / F.col("d"))))
        parts = sizes.select("d", "cell", F.ceil(F.col("n") / each).cast("int").alias("parts"))
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(parts.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]))
        anchors = index.where("anchor").groupBy("id").agg(F.min(F.struct("label", "v", "d")).alias("r")).select("id", "r.*")
        entry = lambda place, other, score: F.struct(place.alias("place"), other.alias("other"), score.alias("score"))
        start = anchors.withColumn("wins", F.array(entry(F.lit(1), F.lit(0).cast("long"), F.lit(_NEVER + 1).cast("long"))))
        near = written(_searched(index, parts, start, shared, radii, Ask(True, positives), tasks))
        wins = near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(entry(F.col("rank"), F.col("found_id"), F.col("found_score"))).alias("wins"))
        out = _searched(index, parts, anchors.join(wins, "id"), shared, radii, Ask(False, negatives, low, high), tasks)
        return written(out.select("anchor_id", F.col("other").alias("positive_id"), "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("positive_score"), F.col("found_score").alias("negative_score")), keep=True)


def _part_rows(d: int) -> int:
    """Rows of a part of vectors of one length."""
    return min(PART_ROWS, max(LEAF, PART_VALUES // d))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row of ``embeddings`` whose id is divisible by 100; odd rows as in ``hard_negatives``."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
 FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS id, b.label, list_dot_product(a.v, b.v)::BIGINT AS score
 FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
 id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
 WHERE label <> anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10"""
