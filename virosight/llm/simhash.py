"""Near-duplicate documents by SimHash: tiles of fingerprints compared in full, bit for bit.

A fingerprint has a bit set where over half of a text's hashed word runs have
it.  Documents with equal fingerprints are one class, so copies cost nothing
beyond one aggregation.  The distinct fingerprints are dealt to cells by the
population counts of their four 16-bit parts.  Two fingerprints within the
radius have counts that differ by no more than the radius, all parts together,
so a cell meets itself and the few cells around it and all other pairs of
cells are skipped.  A cell of many fingerprints is cut in tiles; within a pair
of tiles blocks are skipped alike by the counts of all eight bytes.  What is
left is compared by exclusive-or and bit counts, so no pair within the radius
is lost and none is estimated.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from virosight.llm.near_dups import components
from virosight.llm.text import SPACED, blocks, encoded, scratch, shards, slices, written

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a tile, and rows of tiles in a task on average.
TILE, TASK_ROWS = 1 << 16, 200_000
#: Pairs that are compared in one numpy call, and from which on a pair of tiles is cut in blocks by byte counts.
CALL, CUT = 1 << 20, 1 << 20
#: Salts of a class in the join that gives its documents their component.
SALTS = 16

_ONES = np.uint64(0x0101010101010101)


def _joined(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of all texts with one space behind each, where each word starts and ends, and each text's first word."""
    data = np.frombuffer(b" ".join([t or b"" for t in texts]).translate(SPACED) + b" ", np.uint8)
    word = data != 32
    keep = word.copy()
    keep[1:] |= word[:-1]
    starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    line = data[keep]
    ends = np.flatnonzero(line == 32)
    return line.tobytes(), np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends, ends, first


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes (one at least) the bits that over half of them have set."""
    pieces = -(-counts // 255)
    before = np.cumsum(pieces) - pieces
    starts = np.repeat(np.cumsum(counts) - counts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(before, pieces))
    out = np.zeros(len(counts), np.uint64)
    for k in range(8):
        # Bit k of each byte, added up in eight lanes of a word: no lane passes 255.
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _ONES, starts).view(np.uint8).reshape(-1, 8)
        most = 2 * np.add.reduceat(lanes.astype(np.int64), before, axis=0) > counts[:, None]
        out |= most.astype(np.uint8).view(np.uint64).reshape(-1) << np.uint64(k)
    return out


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """SimHash of each UTF-8 text: runs of ``SHINGLE`` words, repeats included; fewer words are one run, none give zero."""
    import xxhash

    line, starts, ends, first = _joined(texts)
    words = np.diff(first)
    counts = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    full = np.flatnonzero(counts)
    counts = counts[full]
    low = np.repeat(first[full], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    high = low + np.repeat(np.minimum(words[full], SHINGLE), counts) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[low].tolist(), ends[high].tolist(), strict=True)), np.uint64, len(low))
    out = np.zeros(len(texts), np.uint64)
    if len(full):
        out[full] = _majority(hashes, counts)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = encoded(batch.column(1))
        for start, end in blocks(texts):
            prints = fingerprints(texts[start:end]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(prints)], names=["id", "print"])


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as the pairs (a, b), at most one a fingerprint."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        old = root.copy()
        for side in (x, y):
            np.minimum.at(root, root[side], least)
            np.minimum.at(root, side, least)
        root = root[root]
        if (root == old).all():
            break
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[moved]], nodes[moved]


def _compared(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of different fingerprints of two tiles within the radius."""
    out = []
    for k in range(0, len(left), rows := max(1, CALL // max(1, len(right)))):
        own = left[k : k + rows]
        apart = np.bitwise_count(own[:, None] ^ right[None, :])
        i, j = np.nonzero((apart <= radius) & (apart > 0))
        out.append((own[i], right[j]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _by_bytes(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints ordered by the population counts of their bytes, the different counts, and where each starts."""
    counts = np.bitwise_count(prints.view(np.uint8).reshape(-1, 8)).astype(np.int64)
    key = counts @ 9 ** np.arange(8)
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    return prints[order], counts[order[starts]], np.append(starts, len(prints))


def tile_links(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links ``a, b`` that join all fingerprints of two tiles (uint64) that lie within the radius of each other."""
    if len(left) * len(right) <= CUT:
        a, b = _compared(left, right, radius)
    else:
        (left, own, at), (right, other, to) = _by_bytes(left), _by_bytes(right)
        found = [(left[:0], left[:0])]
        for k, counts in enumerate(own):
            near = np.flatnonzero(np.abs(other - counts).sum(1) <= radius)
            if len(near):
                found.append(_compared(left[at[k] : at[k + 1]], np.concatenate([right[to[j] : to[j + 1]] for j in near]), radius))
        a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    return _spanning(a, b) if len(a) else (a, b)


def _tile_links(radius: int):
    """mapInArrow function over rows sorted by tile pair and side: the links within each pair of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def links() -> Iterator[pa.RecordBatch]:
            if all(sides):
                a, b = tile_links(*(np.concatenate(x).view(np.uint64) for x in sides), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(4)])
            prints = batch.column(4).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), keys.shape[1]]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                *tile, side = keys[:, start].tolist()
                if tile != now:
                    yield from links()
                    now, sides = tile, ([], [])
                sides[side].append(prints[start:end])
        yield from links()

    return run


def _cell(print_col: Column) -> Column:
    """Population counts of the four 16-bit parts, five bits each."""
    counts = [F.bit_count(F.shiftrightunsigned(print_col, 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    return sum((F.shiftleft(c, 5 * k) for k, c in enumerate(counts[1:], 1)), counts[0]).cast("int")


def _around(radius: int) -> list[int]:
    """What is added to a cell to give it and half of the cells around it; the other half meets it from the other side."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    return [sum(x << 5 * k for k, x in enumerate(d)) for d in steps]


def links_within(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` that join all distinct fingerprints (column ``print``, 64 bits each as a long) within ``radius`` bits (14 at most).

    There are at most 17 ** 4 cells, so the tables of cells are bounded.  A
    row goes once to its own cell and once to each cell around it, and again
    for each further ``TILE`` fingerprints that it has to meet.
    """
    if not 0 <= radius <= 14:
        raise ValueError("a radius is from 0 to 14")
    rows = prints.select("print", _cell(F.col("print")).alias("cell"), F.abs(F.hash("print")).alias("seat"))
    cells = written(rows.groupBy("cell").agg(F.count("*").alias("n")))
    meets = cells.select(F.col("cell").alias("tile"), "n", F.explode(F.array(*map(F.lit, _around(radius)))).alias("d")).withColumn("cell", F.col("tile") + F.col("d"))
    meets = meets.join(cells.select("cell", F.col("n").alias("m")), "cell")
    count = lambda n: F.ceil(n / TILE).cast("int")
    size = meets.groupBy("tile").agg(count(F.first("n")).alias("parts"), count(F.sum("m")).alias("chunks"))
    meets = meets.select("tile", "cell").join(size, "tile")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = rows.join(size.withColumnRenamed("tile", "cell"), "cell").select(F.col("cell").alias("tile"), F.pmod("seat", "parts").alias("part"), every("chunks").alias("chunk"), F.lit(0).alias("side"), "print")
    other = rows.join(meets, "cell").select("tile", every("parts").alias("part"), F.pmod("seat", "chunks").alias("chunk"), F.lit(1).alias("side"), "print")
    tasks = shards(prints.sparkSession, 22 * int(cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), TASK_ROWS)
    tile = ["tile", "part", "chunk"]
    dealt = own.unionByName(other).repartition(tasks, *tile).sortWithinPartitions(*tile, "side")
    return written(dealt.mapInArrow(_tile_links(radius), "a long, b long"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row: ``id_col, fingerprint, component_id``.

    Rows whose fingerprints differ in ``radius`` bits or fewer are linked;
    ``component_id`` is the least id reachable.  A null, empty or wordless
    text has the fingerprint zero, which links like any other, and a text of
    fewer than three words is one run.  Very long texts are hashed whole.
    Rows with a null id are linked with nothing and have a null component.
    Repeated rows all stay; rows that share an id but no text are told apart
    by their fingerprints.  No document gives no row.  Other columns are not
    read.  Ids are integers.
    """
    with scratch():
        narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        prints = written(narrow.mapInArrow(_fingerprints, "id long, print long"))
        classes = written(prints.where("id is not null").groupBy("print").agg(F.min("id").alias("id"), F.count("*").alias("n")))
        links = links_within(classes, radius)
        roots = written(components(links))
        # Only fingerprints of several rows or with links need a look-up; any other row stands for itself.
        heads = roots.select("root").distinct().select(F.col("root").alias("node"), "root")
        linked = roots.unionByName(heads)
        held = classes.join(linked.withColumnRenamed("node", "print"), "print", "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "print"))
        least = held.groupBy("root").agg(F.min("id").alias("component"))
        placed = held.join(least, "root").select("print", "component", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
        salted = prints.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        out = salted.join(placed, ["print", "salt"], "left")
        digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
        return written(out.select(F.col("id").alias(id_col), digits.alias("fingerprint"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")), keep=True)


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``; odd rows as in ``simhash_groups``."""
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
