"""Near-duplicate documents: SetSketch registers, banded, estimated by likelihood, verified on whole sets.

A document's set holds its distinct runs of five words.  Documents with equal
sets are one class, stood for by its least id, so copies cost nothing beyond
one small aggregation.  For the classes:

1. bands of registers are hashed; a bucket's least class is its centre, and
   each class is paired with the ``CENTRES`` centres that it shares most
   buckets with, never with all others;
2. pairs meet their registers first: those whose likelihood estimate is far
   below the threshold go, and only the rest meet their texts and are verified
   on the whole sets;
3. verified links give components.  A bucket that still holds several
   components is searched where it lies: its classes outside its largest
   component (the probes) meet all its classes, in tiles that have a bound on
   rows and on bytes, by estimate and then on their sets.  Each pair is looked
   at in the first bucket that it shares, and only links leave the task.

So no link between two classes that share a bucket is lost.  With 32 bands of
4 registers two sets at the threshold of 0.85 miss all buckets with a chance
below 1e-10, at 0.8 below 1e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from virosight.llm.setsketch import REGISTERS, band_hashes, estimate, sketch
from virosight.llm.text import SPACED, blocks, discard, encoded, gram_hashes, scratch, shards, slices, word_hashes, written
from virosight.llm.worker import lean

SHINGLE, ROWS, THRESHOLD = 5, 4, 0.8
#: Centres that a class is first compared with.
CENTRES = 3
#: Classes, probes among them, and packed bytes of either in a tile of a searched bucket; and rows of tiles in one task, all on average.
TILE, PROBES, TILE_BYTES, OPEN_ROWS = 600, 600, 4 << 20, 1_000
#: Salts of a bucket in the join that deals its rows.
SALTS = 8
#: Salts of a class in the join that gives its copies their component.
COPY_SALTS = 16
#: Shingles whose sets a tile holds at once.
HELD_SHINGLES = 4_000_000
#: Packed bytes of pairs whose sets are built at once.
PAIR_BYTES = 4 << 20
#: Pairs whose estimate lies this far below the threshold are not verified: over four standard errors of 128 registers.
MARGIN = 0.16


def shingle_sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their offsets.

    A text of fewer words is one shingle as a whole; a text without words has none.
    """
    words, at = word_hashes(texts, SPACED)
    grams = gram_hashes(words, SHINGLE)
    counts = np.diff(at)
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for i, n in enumerate(counts.tolist()):
        start = at[i]
        if n >= SHINGLE:
            own = np.unique(grams[start : start + n - SHINGLE + 1])
        elif n:
            own = gram_hashes(words[start : start + n], n) + np.uint64(n)
        else:
            continue
        parts.append(own)
        sizes[i] = len(own)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def _pack(text: bytes, squeeze) -> bytes:
    return squeeze.compress(b" ".join(text.translate(SPACED).split()))


@lean()
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = encoded(batch.column(1))
        for start, end in blocks(texts):
            part = texts[start:end]
            hashes, at = shingle_sets(part)
            sizes = np.diff(at)
            registers = sketch(hashes, np.repeat(np.arange(len(part)), sizes), len(part))
            bands = band_hashes(registers, ROWS).view(np.int64)
            full = sizes > 0
            keys = [hashlib.blake2b(hashes[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() if full[i] else None for i in range(len(part))]
            bodies = [_pack(t, squeeze) if f else None for t, f in zip(part, full, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(start, end - start), pa.array(sizes), pa.array(keys, pa.binary()),
                    pa.array([r.tobytes() if f else None for r, f in zip(registers, full, strict=True)], pa.binary()),
                    pa.array([b if f else None for b, f in zip(bands, full, strict=True)], pa.list_(pa.int64())),
                    pa.array(bodies, pa.binary()), pa.array([len(b) if b else 0 for b in bodies], pa.int64()),
                ],
                names=["id", "n", "key", "registers", "bands", "body", "size"],
            )


def _sets(bodies: list[bytes]) -> list[np.ndarray]:
    """Shingle sets of packed texts."""
    import zstandard

    expand = zstandard.ZstdDecompressor()
    out = []
    texts = [expand.decompress(b) for b in bodies]
    for start, end in blocks(texts):
        hashes, at = shingle_sets(texts[start:end])
        out += [hashes[at[i] : at[i + 1]] for i in range(end - start)]
    return out


def _likely(percent: int):
    """mapInArrow function over pairs with both sides' size and registers: the pairs ``a, b`` whose estimate is not far below the threshold."""
    cut = percent / 100 - MARGIN

    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            regs = [np.frombuffer(b"".join(col[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("registers_a", "registers_b")]
            sizes = [col[c].to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b")]
            at = pa.array(np.flatnonzero(estimate(*regs, *sizes) >= cut))
            yield pa.RecordBatch.from_arrays([col["a"].take(at), col["b"].take(at)], names=["a", "b"])

    return run


def _verifier(percent: int):
    """mapInArrow function over pairs with both sides' body: the linked pairs ``a, b``."""

    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            linked = []
            weight = sum(pc.binary_length(col[f"body_{side}"]).to_numpy(zero_copy_only=False) for side in "ab")
            for some in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(np.cumsum(weight) // PAIR_BYTES)) + 1):
                bodies = {}
                for side in "ab":
                    ids, body = col[side].take(pa.array(some)).to_pylist(), col[f"body_{side}"].take(pa.array(some)).to_pylist()
                    bodies |= dict(zip(ids, body, strict=True))
                found = dict(zip(bodies, _sets(list(bodies.values())), strict=True))
                for i in some:
                    a, b = found[col["a"][i].as_py()], found[col["b"][i].as_py()]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if 100 * both >= percent * (len(a) + len(b) - both):
                        linked.append(i)
            at = pa.array(np.array(linked, np.int64))
            yield pa.RecordBatch.from_arrays([col["a"].take(at), col["b"].take(at)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """The linked pairs; a pair's bodies are fetched only if its registers make a link likely."""
    shape = f"a {dict(pairs.dtypes)['a']}, b {dict(pairs.dtypes)['b']}"

    def beside(pairs: DataFrame, *columns: str) -> DataFrame:
        for side in "ab":
            # The texts' side is never small where that matters, so the join is the same at every size.
            pairs = pairs.hint("merge").join(prints.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
        return pairs.select("a", "b", *(f"{c}_{s}" for c in columns for s in "ab"))

    likely = written(beside(pairs, "n", "registers").mapInArrow(_likely(percent), shape))
    return beside(likely, "body").mapInArrow(_verifier(percent), shape)


def components(edges: DataFrame) -> DataFrame:
    """Least node reachable from each node of the undirected ``edges`` (a, b): rows ``node, root``, the roots left out.

    Rounds of joining each node's neighbours to their least one, by
    aggregations and joins alone (no group is gathered), until no edge
    changes; each round is written to the shared folder.
    """
    edges = written(edges.where("a != b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        previous, edges = edges, written(small.where("u != v").distinct().select("v", "u"))
        discard(previous)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _hidden_links(percent: int):
    """mapInArrow function over rows sorted by tile: links ``a, b`` between different components.

    A tile holds probes and classes of one bucket.  A probe meets every class
    of another component once: two probes meet where the lesser id is the probe.
    """
    cut = percent / 100 - MARGIN

    def links(rows: pa.Table) -> pa.RecordBatch:
        band = rows.column("band")[0].as_py()
        is_probe, rest = (rows.column(c).to_numpy() for c in ("probe", "rest"))
        ids, roots, sizes = (rows.column(c).to_numpy() for c in ("id", "root", "n"))
        sizes, bodies = sizes.astype(float), rows.column("body")
        registers = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        classes = np.flatnonzero(~is_probe)
        place, out = roots.copy(), []
        sets: dict[int, np.ndarray] = {}
        held = 0
        for i in np.flatnonzero(is_probe):
            near = classes[(place[classes] != place[i]) & (~rest[classes] | (ids[i] < ids[classes]))]
            near = near[np.minimum(sizes[near], sizes[i]) * 100 >= percent * np.maximum(sizes[near], sizes[i])]
            same = registers[near] == registers[i]
            first = same.reshape(len(near), REGISTERS // ROWS, ROWS).all(2).argmax(1) == band
            near = near[(same.mean(1) >= cut - 0.05) & first]
            if not len(near):
                continue
            j = estimate(np.broadcast_to(registers[i], (len(near), REGISTERS)), registers[near], np.full(len(near), sizes[i]), sizes[near])
            near = near[np.argsort(-j, kind="stable")[: (j >= cut).sum()]]
            own = _sets([bodies[int(i)].as_py()])[0] if len(near) else None
            for k in near.tolist():
                if place[i] == place[k]:
                    continue
                if k not in sets:
                    if held > HELD_SHINGLES:
                        sets.clear()
                        held = 0
                    sets[k] = _sets([bodies[k].as_py()])[0]
                    held += len(sets[k])
                both = len(np.intersect1d(own, sets[k], assume_unique=True))
                if 100 * both >= percent * (len(own) + len(sets[k]) - both):
                    out.append((int(min(ids[i], ids[k])), int(max(ids[i], ids[k]))))
                    place[place == place[k]] = place[i]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            edges = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), keys.shape[1]]
            for start, end in zip(edges, edges[1:], strict=False):
                if end > start:
                    if held and now != tuple(keys[:, start]):
                        yield links(pa.Table.from_batches(held))
                        held = []
                    now = tuple(keys[:, start])
                    held.append(batch.slice(start, end - start))
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _tiles(placed: DataFrame) -> DataFrame:
    """Rows of searched buckets (bucket, band, id, root, size) dealt to tiles: ``bucket, part, side, probe, rest, band, id, root``.

    Classes are dealt to parts of about ``TILE`` classes and ``TILE_BYTES``,
    and probes (the classes outside the largest component) to sides alike.  A
    tile is a part and a side, so a bucket of k classes with few probes makes
    about k rows, and no tile grows with the bucket.
    """
    each = placed.groupBy("bucket", "root").agg(F.count("*").alias("k"), F.sum("size").alias("size"))
    main = each.groupBy("bucket").agg(F.max_by(F.struct("root", "size"), F.struct("k", "root")).alias("main"), F.sum("k").alias("k"), (F.sum("k") - F.max("k")).alias("m"), F.sum("size").alias("size"))
    count = lambda n, most, size: F.greatest(F.ceil(n / most), F.ceil(size / TILE_BYTES), F.lit(1)).cast("int")
    main = main.select("bucket", F.col("main.root").alias("main"), count(F.col("k"), TILE, F.col("size")).alias("parts"), count(F.col("m"), PROBES, F.col("size") - F.col("main.size")).alias("sides"))
    seat = F.xxhash64("id")
    salted = main.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = placed.withColumn("salt", F.pmod(F.xxhash64("id", F.lit("salt")), F.lit(SALTS)).cast("int")).join(salted, ["bucket", "salt"]).withColumn("rest", F.col("root") != F.col("main"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keep = ["rest", "band", "id", "root"]
    classes = rows.select("bucket", F.pmod(seat, "parts").cast("int").alias("part"), every("sides").alias("side"), F.lit(False).alias("probe"), *keep)
    probes = rows.where("rest").select("bucket", every("parts").alias("part"), F.pmod(seat, "sides").cast("int").alias("side"), F.lit(True).alias("probe"), *keep)
    return classes.unionByName(probes)


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` of all nodes that are no roots, after more links between components."""
    ends = links
    for side in "ab":
        ends = ends.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"_{side}")), side, "left")
    more = components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    moved = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("_new")), "root", "left")
    return written(moved.select("node", F.coalesce("_new", "root").alias("root")).unionByName(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = round(THRESHOLD * 100)) -> DataFrame:
    """One row per row: ``id_col, n_shingles, component_id, kept``.

    Documents are linked if the Jaccard similarity of their sets is
    ``percent`` hundredths at least; ``component_id`` is the least id
    reachable over links and ``kept`` marks the row with that id.  A null,
    empty or wordless text and a row with a null id are linked with nothing
    and kept.  Rows with equal ids count as one document; repeated rows all
    stay.  A similarity of exactly ``percent`` hundredths links.  Very long
    texts are hashed range by range.  No document gives no row.  Ids are
    integers.  Other columns are not read.
    """
    with scratch():
        narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        prints = written(narrow.mapInArrow(_fingerprints, "id long, n long, key binary, registers binary, bands array<long>, body binary, size long"))
        known = prints.where("id is not null and key is not null")
        classes = known.groupBy("key").agg(F.min("id").alias("id"))
        reps = known.select("id", "key", "bands").join(classes, ["id", "key"], "left_semi")
        bands = written(reps.select("id", F.posexplode("bands").alias("band", "bucket")).distinct())
        centre = bands.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("k")).where("k > 1").drop("k")
        shared = bands.withColumnRenamed("id", "b").join(centre, "bucket").where("a != b").groupBy("b", "a").agg(F.count("*").alias("k"))
        most = shared.groupBy("b").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "a"))), 1, CENTRES).alias("m"))
        pairs = written(most.select("b", F.explode("m.a").alias("a")))
        links = written(_verified(pairs, known, percent))
        roots = components(links)
        # Buckets in which a link between two components may still be hidden.
        placed = bands.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        split = placed.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("k")).where("least != most")
        placed = written(placed.join(split.select("bucket", "k"), "bucket").select("bucket", "band", "id", "root", "k"))
        # Only a bucket of two classes that were compared above is left out.
        twos = placed.where("k = 2").groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("b"))
        placed = placed.join(twos.join(pairs, ["a", "b"], "left_semi").select("bucket"), "bucket", "left_anti").drop("k")
        sized = known.groupBy("id").agg(F.max("size").alias("size"))
        tiles = written(_tiles(placed.join(sized, "id")))
        # Ranges of tiles hold about as many rows each, and a tile is never cut.
        parts = shards(prints.sparkSession, tiles.count(), OPEN_ROWS)
        order = ["bucket", "part", "side"]
        dealt = tiles.hint("merge").join(known.select("id", "n", "registers", "body"), "id").select(*order, "probe", "rest", "band", "id", "root", "n", "registers", "body").repartitionByRange(parts, *order).sortWithinPartitions(*order)
        more = written(dealt.mapInArrow(_hidden_links(percent), "a long, b long"))
        if not more.isEmpty():
            roots = _merged(roots, more)
        # Classes of several rows or with links are looked up, under salts; any other row stands for itself.
        many = known.groupBy("key").agg(F.count("*").alias("k"))
        linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        placed = classes.join(many, "key").join(linked.withColumnRenamed("node", "id"), "id", "left").where("k > 1 or root is not null").select("key", F.coalesce("root", "id").alias("root"))
        salted = placed.withColumn("salt", F.explode(F.array(*map(F.lit, range(COPY_SALTS)))))
        # A row without a key gets its salt as one, so that such rows don't meet in one task.
        salt = F.pmod(F.xxhash64("id"), F.lit(COPY_SALTS)).cast("int")
        rows = prints.select("id", "n", F.when(F.col("id").isNotNull() & F.col("key").isNotNull(), F.col("key")).otherwise(F.unhex(F.hex(F.xxhash64("id")))).alias("key"), salt.alias("salt"))
        component = F.coalesce("root", "id")
        out = rows.join(salted, ["key", "salt"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
        return written(out, keep=True)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and whether it is kept of every row of ``documents``, at 85 hundredths; odd rows as in ``near_duplicates``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = round(THRESHOLD * 100)) -> DataFrame:
    """One document of each group of near duplicates, all columns kept; rows with a null id stay."""
    gone = near_duplicates(docs, id_col, text_col, percent).where("not kept").select(F.col(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


_SETS = r"""
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM inter JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= {percent} * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
root AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)"""

ORACLE = f"""
WITH RECURSIVE {_SETS.format(percent=85)}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN root USING (doc_id) LEFT JOIN n USING (doc_id)"""
