"""Counts of states at the places of sequences, without a row for each character.

A task counts the texts of its batches as sorted arrays of (place, state) keys
and sends, for each block of ``BLOCK`` places and each group, one row with two
arrays.  What is shuffled so depends on places, states and tasks and not on
how much text was counted.  The blocks are merged where they meet, and a place
is one row with the arrays of its states and counts, from which frequencies,
entropies, consensus and distances follow in the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from virosight.session import bounded_batches, saved

#: Places of a block, characters counted in one call, and different (place, state) keys that a task holds.
BLOCK, CALL, HELD = 4096, 1 << 22, 1 << 22
#: Half the keys that wait to be added up where blocks meet, places of a piece of text, characters of pieces counted in one call, and deals of the first pieces.
WAITING, PIECE, PIECES_CALL, DEALS = 1 << 15, 1024, 1 << 18, 8
#: Bits of a state: a Unicode code point.
_BITS = 21
_CODE = (1 << _BITS) - 1


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after another, and the texts' lengths."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.fromiter(map(len, texts), np.int64, len(texts))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class _Sums:
    """Counts of sorted distinct keys that come in parts, added up whenever more have come than are held."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > 2 * max(self.held, WAITING):
            self.whole()

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [_summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        self.size = self.held = len(self.parts[0][0])
        return self.parts[0]


def _keys(texts: list[str], weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    codes, sizes = code_points(texts)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = place << _BITS | codes
    if weights is not None:
        return _summed(keys, np.repeat(weights, sizes))
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.diff(np.append(first, len(keys)))


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values))


def _counter(weighted: bool):
    """mapInArrow function over sequence, weight (if any) and groups: ``at`` and ``n`` arrays of each group and block."""
    skip = 1 + weighted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        fields: list[pa.Field] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for group, parts in held.items():
                keys, counts = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                block = (keys >> _BITS) // BLOCK
                first = np.flatnonzero(np.diff(block, prepend=-1))
                columns = [pa.array([g] * len(first), f.type) for g, f in zip(group, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(block[first].astype(np.int32)), _lists(keys, first), _lists(counts, first)], names=[*(f.name for f in fields), "block", "at", "n"])

        for batch in batches:
            fields = list(batch.schema)[skip:]
            texts, groups = batch.column(0).to_pylist(), list(zip(*(c.to_pylist() for c in batch.columns[skip:]), strict=True)) or [()] * batch.num_rows
            weights = batch.column(1).to_numpy(zero_copy_only=False) if weighted else None
            rows: dict[tuple, list[int]] = {}
            for i, (text, group) in enumerate(zip(texts, groups, strict=True)):
                if text:
                    rows.setdefault(group, []).append(i)
            for group, own in rows.items():
                ends = np.cumsum([len(texts[i]) for i in own])
                for some in np.split(np.array(own), np.flatnonzero(np.diff(ends // CALL)) + 1):
                    part = _keys([texts[i] for i in some], weights[some] if weighted else None)
                    held.setdefault(group, []).append(part)
                    size += len(part[0])
            if size > HELD:
                held = {g: [_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))] for g, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD // 2:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return run


def _merger(groups: int):
    """mapInArrow function over rows sorted by group and block: one row ``pos, states, counts, total`` a place."""

    def places(group: tuple, fields: list[pa.Field], sums: _Sums) -> pa.RecordBatch:
        keys, counts = sums.whole()
        pos, code = keys >> _BITS, keys & _CODE
        first = np.flatnonzero(np.diff(pos, prepend=-1))
        known, which = np.unique(code, return_inverse=True)
        states = pa.array([chr(c) for c in known.tolist()]).take(pa.array(which))
        offsets = pa.array(np.append(first, len(keys)).astype(np.int32))
        columns = [pa.array([g] * len(first), f.type) for g, f in zip(group, fields, strict=True)]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array((pos[first] + 1).astype(np.int32)), pa.ListArray.from_arrays(offsets, states), pa.ListArray.from_arrays(offsets, pa.array(counts)), pa.array(np.add.reduceat(counts, first))],
            names=[*(f.name for f in fields), "pos", "states", "counts", "total"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, fields = None, None, []
        for batch in batches:
            fields = list(batch.schema)[:groups]
            at, n = batch.column(groups + 1), batch.column(groups + 2)
            for i, key in enumerate(zip(*(c.to_pylist() for c in batch.columns[: groups + 1]), strict=True)):
                if sums and key != now:
                    yield places(now[:-1], fields, sums)
                    sums = None
                now, sums = key, sums or _Sums()
                sums.add(at[i].values.to_numpy(), n[i].values.to_numpy())
        if sums:
            yield places(now[:-1], fields, sums)

    return run


def _partial(df: DataFrame, seq: str, by: list[str], weight: Column | None) -> DataFrame:
    """``by, block, at, n``: each task's counts of each group and block."""
    weights = [] if weight is None else [F.coalesce(weight.cast("double"), F.lit(0.0)).alias("_weight")]
    rows = df.select(F.col(seq).alias("_seq"), *weights, *by)
    value = LongType() if weight is None else DoubleType()
    shape = [*(StructField(c, rows.schema[c].dataType) for c in by), StructField("block", IntegerType()), StructField("at", ArrayType(LongType())), StructField("n", ArrayType(value))]
    return rows.mapInArrow(_counter(weight is not None), StructType(shape))


def pileup(df: DataFrame, seq: str, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """``by, pos, states, counts, total``: a row for each place (from 1) of the sequences of each group, its states in code-point order.

    Counts are rows, or sums of ``weight`` (a double; null counts as 0).  Null
    and empty sequences count nowhere.
    """
    by = by or []
    partial = _partial(df, seq, by, weight)
    dealt = partial.repartition(*by, "block").sortWithinPartitions(*by, "block")
    value = partial.schema["n"].dataType
    shape = [*(partial.schema[c] for c in by), StructField("pos", IntegerType()), StructField("states", ArrayType(StringType())), StructField("counts", value), StructField("total", value.elementType)]
    return dealt.mapInArrow(_merger(len(by)), StructType(shape))


def frequencies(piles: DataFrame, alphabet: str | None = None, by: list[str] | None = None) -> DataFrame:
    """``by, pos, state, n, freq``: states outside the alphabet count in the denominator alone."""
    both = piles.select(*(by or []), "pos", "total", F.explode(F.arrays_zip(F.col("states").alias("state"), F.col("counts").alias("n"))).alias("s"))
    out = both.select(*(by or []), "pos", "s.state", "s.n", (F.col("s.n") / F.col("total")).alias("freq"))
    return out if alphabet is None else out.where(F.col("state").isin(list(alphabet)))


def entropy(piles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Shannon entropy (natural logarithm) and the observed states of each place."""
    share = lambda n: n / F.col("total")
    total = F.aggregate("counts", F.lit(0.0), lambda acc, n: acc + share(n) * F.ln(F.greatest(share(n), F.lit(1e-10))))
    return piles.select(*(by or []), "pos", F.abs(total).alias("entropy"), "states")


def consensus(piles: DataFrame, alphabet: str, by: list[str] | None = None) -> DataFrame:
    """Most frequent state of each place among those of the alphabet; ties go to the first there."""
    both = F.arrays_zip(F.col("counts").alias("n"), F.col("states").alias("state"))
    known = F.filter(F.transform(both, lambda x: F.struct(x["n"].alias("n"), (-F.instr(F.lit(alphabet), x["state"])).alias("seat"), x["state"].alias("state"))), lambda x: x["seat"] < 0)
    return piles.select(*(by or []), "pos", F.array_max(known).alias("_best")).where("_best is not null").select(*(by or []), "pos", F.col("_best.state").alias("state"))


def variable_sites(piles: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Places whose most frequent state is below 1 - threshold."""
    return piles.select(*(by or []), "pos", (F.array_max("counts") / F.col("total")).alias("top")).where(F.col("top") < 1 - threshold)


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows ``group, block, at, n`` sorted by block: each group's summed products with all groups, and the block's places (on one row)."""

    def products(parts: dict[object, _Sums], kind: pa.DataType) -> pa.RecordBatch:
        own = {g: sums.whole() for g, sums in parts.items()}
        keys, counts = _summed(*(np.concatenate(x) for x in zip(*own.values(), strict=True)))
        share = lambda k, n: n / np.bincount(k >> _BITS, weights=n)[k >> _BITS]
        low = keys[0] >> _BITS << _BITS
        p = share(keys - low, counts)
        sums = [float((p[np.searchsorted(keys, k)] * share(k - low, n)).sum()) for k, n in own.values()]
        places = [len(np.unique(keys >> _BITS)), *[0] * (len(own) - 1)]
        return pa.RecordBatch.from_arrays([pa.array(list(own), kind), pa.array(sums), pa.array(places)], names=["g", "s", "places"])

    now, parts, kind = None, {}, None
    for batch in batches:
        kind = batch.schema.types[0]
        at, n = batch.column(2), batch.column(3)
        for i, (group, block) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if parts and block != now:
                yield products(parts, kind)
                parts = {}
            now = block
            parts.setdefault(group, _Sums()).add(at[i].values.to_numpy(), n[i].values.to_numpy())
    if parts:
        yield products(parts, kind)


def _piece_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows ``group, block, text`` sorted by block and group: ``group, block, at, n``, the counts of a block's places (from 0) in one row."""

    def counted(group: object, block: int, kind: pa.DataType) -> pa.RecordBatch:
        sums.add(*_keys(texts, None))
        keys, counts = sums.whole()
        zero = np.zeros(1, np.int64)
        return pa.RecordBatch.from_arrays([pa.array([group], kind), pa.array([block], pa.int32()), _lists(keys, zero), _lists(counts, zero)], names=["g", "block", "at", "n"])

    now, kind, sums, texts, size = None, None, _Sums(), [], 0
    for batch in batches:
        kind = batch.schema.types[0]
        for *key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now and key != now:
                yield counted(*now, kind)
                sums, texts, size = _Sums(), [], 0
            now = key
            texts.append(text)
            size += len(text)
            if size > PIECES_CALL:
                sums.add(*_keys(texts, None))
                texts, size = [], 0
    if now:
        yield counted(*now, kind)


def population_distance(df: DataFrame, seq: str, by: str) -> DataFrame:
    """``by, distance``: 1 less the mean over places of the summed products of a group's frequencies and those of all groups.

    Sequences are cut in pieces of ``PIECE`` places, which meet by block and
    group and are counted there, so what is shuffled is the text once and then
    one row of counts a block, group and deal; the first blocks, which all
    sequences have, are dealt to several tasks.  A task holds the counts of one
    block, those of all groups at the end, so groups are populations and not rows.
    """
    bounded_batches(df.sparkSession)
    starts = F.sequence(F.lit(0), F.floor((F.length(seq) - 1) / PIECE).cast("int"))
    cut = F.transform(starts, lambda b: F.struct(b.alias("block"), F.substring(F.col(seq), b * PIECE + 1, F.lit(PIECE)).alias("text")))
    pieces = df.where(F.length(seq) > 0).select(F.col(by).alias("g"), F.monotonically_increasing_id().alias("id"), F.explode(cut).alias("p")).select("g", "id", "p.block", "p.text")
    deal = F.pmod("id", F.greatest(F.floor(F.lit(DEALS) / (1 + F.col("block"))), F.lit(1)))
    dealt = pieces.withColumn("deal", deal).repartition("block", "g", "deal").select("g", "block", "text").sortWithinPartitions("block", "g")
    kind = StructField("g", pieces.schema["g"].dataType)
    counts = dealt.mapInArrow(_piece_counts, StructType([kind, StructField("block", IntegerType()), StructField("at", ArrayType(LongType())), StructField("n", ArrayType(LongType()))]))
    sums = saved(counts.repartition("block").sortWithinPartitions("block").mapInArrow(_distances, StructType([kind, StructField("s", DoubleType()), StructField("places", LongType())])))
    places = sums.agg(F.sum("places").alias("_places"))
    return sums.groupBy(F.col("g").alias(by)).agg(F.sum("s").alias("_s")).join(F.broadcast(places)).select(by, (1 - F.col("_s") / F.col("_places")).alias("distance"))


def _difference_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sequence, root and kept columns: a row for each place where both have a letter and differ."""
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            batch = whole.slice(k, 256)
            rows, places, states = [], [], []
            roots: dict[str, np.ndarray] = {}
            for i, (text, root) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if not text or not root:
                    continue
                if root not in roots:
                    roots[root] = code_points([root])[0]
                own = code_points([text[: len(root)]])[0]
                at = np.flatnonzero(own != roots[root][: len(own)])
                rows.append(np.full(len(at), i))
                places.append(at + 1)
                states.append(own[at])
            if rows:
                row, place, code = (np.concatenate(x) for x in (rows, places, states))
                known, which = np.unique(code, return_inverse=True)
                kept = [c.take(pa.array(row)) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(place.astype(np.int32)), pa.array([chr(c) for c in known.tolist()], pa.string()).take(pa.array(which))], names=[*batch.schema.names[2:], "pos", "state"])


def differences_from_root(df: DataFrame, root: Column, seq: str, *keep: str) -> DataFrame:
    """``keep, pos, state`` of the places of each sequence that differ from the root: the sparse export.  Places behind the end of either are none."""
    rows = df.select(F.col(seq).alias("_seq"), root.alias("_root"), *keep)
    return rows.mapInArrow(_difference_rows, StructType([*(StructField(c, rows.schema[c].dataType) for c in keep), StructField("pos", IntegerType()), StructField("state", StringType())]))


def has_states(seq: Column, criteria: list[tuple[int, str]]) -> Column:
    """Whether a sequence has every (place, state); no place is looked at but these."""
    met = [F.substring(seq, pos, 1) == state for pos, state in criteria]
    out = met[0]
    for m in met[1:]:
        out = out & m
    return F.coalesce(out, F.lit(False))


def _scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by block and deal, scores before texts: the summed score of each piece of text."""
    now, keys, values = None, np.empty(0, np.int64), np.empty(0)
    for batch in batches:
        at, own = batch.column(3), batch.column(4)
        ids, sums = [], []
        for i, (block, deal, text, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True)):
            if (block, deal) != now:
                now, keys, values = (block, deal), np.empty(0, np.int64), np.empty(0)
            if text is None:
                keys, values = at[i].values.to_numpy(), own[i].values.to_numpy()
                continue
            wanted = np.arange(len(text)) << _BITS | code_points([text])[0]
            ids.append(key)
            if len(keys):
                place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                sums.append(float(values[place][keys[place] == wanted].sum()))
            else:
                sums.append(0.0)
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.types[5]), pa.array(sums, pa.float64())], names=["key", "score"])


def place_scores(df: DataFrame, seq: str, key: str, scores: DataFrame, out: str = "score", deals: int = 32) -> DataFrame:
    """``key, out``: sum over a sequence's places of the score of its state there; ``scores`` has (pos, state, value), others count 0.

    Scores are gathered to one row for each block of places.  Texts are cut in
    pieces of a block and meet the block's scores in ``deals`` tasks, so the
    first block, which all texts have, is no hot key.  Every key stays, null too.
    """
    code, place = F.ascii("state"), (F.col("pos") - 1) % BLOCK
    rows = scores.select(F.floor((F.col("pos") - 1) / BLOCK).cast("int").alias("block"), (F.shiftleft(place.cast("long"), _BITS) + code).alias("at"), F.col("value").cast("double").alias("v"))
    lists = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("s")).select("block", F.col("s.at").alias("at"), F.col("s.v").alias("v"))
    kind = dict(df.dtypes)[key]
    table = lists.select("block", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), F.lit(None).cast("string").alias("text"), "at", "v", F.lit(None).cast(kind).alias("key"))
    starts = F.sequence(F.lit(0), F.floor((F.length(seq) - 1) / BLOCK).cast("int"))
    cut = F.transform(starts, lambda b: F.struct(b.alias("block"), F.substring(F.col(seq), b * BLOCK + 1, F.lit(BLOCK)).alias("text")))
    pieces = df.where(F.length(seq) > 0).select(key, F.explode(cut).alias("p"))
    nothing = [F.lit(None).cast(f"array<{t}>").alias(n) for n, t in (("at", "long"), ("v", "double"))]
    pieces = pieces.select("p.block", F.pmod(F.xxhash64(key), F.lit(deals)).cast("int").alias("deal"), "p.text", *nothing, F.col(key).alias("key"))
    dealt = table.unionByName(pieces).repartition("block", "deal").sortWithinPartitions("block", "deal", F.col("text").isNotNull())
    none = df.select(F.col(key).alias("key"), F.lit(0.0).alias("score"))
    return dealt.mapInArrow(_scorer, f"key {kind}, score double").unionByName(none).groupBy(F.col("key").alias(key)).agg(F.sum("score").alias(out))
