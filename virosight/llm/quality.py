"""Quality classifier: an interpolated modified Kneser-Ney model over runs of five bytes.

Training is relational and takes every trusted text, whole.  The runs are
counted and shuffled by run; continuation counts, counts of counts and context
totals are aggregations, and joins of these sharded tables give each run's
probability and each context's weight, order by order.

Documents can be scored in two ways that give the same figures.
``score_sharded`` joins the distinct runs of each block of documents to the
shards of the tables and carries the answers back to the block.  ``score``
takes the tables to the texts, so that no text moves.  Distinct runs of five
bytes grow far slower than the texts that hold them, so the registered query
uses the second while the tables hold at most ``MODEL_ROWS`` rows, and the
first, which moves more than the input (figures in the README), beyond.

A document's score is its mean code length in bits a byte (the logarithm of
its perplexity).  It is rejected if that exceeds the limit of its language: a
quantile of the scores of trusted documents of the language that the model was
not trained on, plus slack.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from virosight.llm.text import blocks, encoded, packed_blocks, scratch, shards, slices, unpacked, written
from virosight.llm.worker import lean, sent

ORDER = 5
#: Most runs of all orders together that are taken to the texts; larger tables stay sharded.
MODEL_ROWS = 4_000_000
#: Text bytes whose runs are counted at once, and distinct runs that a task gathers before it sends them.
COUNTED_BYTES, GATHERED_RUNS = 1 << 20, 1 << 20
#: Of this many trusted texts one is held out, to set the limits with.
HELD_OUT = 4
#: Quantile of held-out scores of a language, and bits a byte above it, that are still kept; held-out texts that a language needs for a limit of its own.
QUANTILE, SLACK, LEAST_HELD = 0.99, 0.15, 30
#: Languages with a limit of their own whose table is broadcast.
MOST_LIMITS = 100_000
#: Bits above the limit that a text may have as a whole: a short text has few bytes to make up for its start.
START_BITS = 30.0
#: Text bytes that are scored at once; a longer text is one block.
SCORED_BYTES = 1 << 18
#: Bytes before the first of a text.
_START = b"\n" * (ORDER - 1)


def _codes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code of the run that ends at each byte of each text, and the texts' offsets; the bytes of a run are base-256 digits."""
    data = np.frombuffer(b"".join([_START + (t or b"") for t in texts]), np.uint8)
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    at = np.concatenate(([0], np.cumsum(sizes)))
    code = np.zeros(max(0, len(data) - ORDER + 1), np.int64)
    for k in range(ORDER):
        code = (code << 8) | data[k : k + len(code)]
    place = np.arange(at[-1]) + np.repeat(np.arange(len(texts)) * (ORDER - 1), sizes)
    return code[place], at


def _ranges(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Codes of all runs of the texts, about ``COUNTED_BYTES`` at a time; a longer text comes range by range."""
    for start, end in blocks(texts, COUNTED_BYTES):
        first = texts[start] or b""
        if end - start > 1 or len(first) <= COUNTED_BYTES:
            yield _codes(texts[start:end])[0]
            continue
        yield _codes([first[:COUNTED_BYTES]])[0]
        for at in range(COUNTED_BYTES, len(first), COUNTED_BYTES):
            # The bytes before the range are the context of its first runs.
            yield _codes([first[at - ORDER + 1 : at + COUNTED_BYTES]])[0][ORDER - 1 :]


@lean()
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs and their numbers, summed within the task as far as ``GATHERED_RUNS`` goes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        run, place = np.unique(np.concatenate([r for r, _ in held]), return_inverse=True)
        n = np.zeros(len(run), np.int64)
        np.add.at(n, place, np.concatenate([c for _, c in held]))
        return run, n

    for batch in slices(batches):
        for codes in _ranges(encoded(batch.column(0))):
            held.append(np.unique(codes, return_counts=True))
            if sum(len(r) for r, _ in held) > GATHERED_RUNS:
                held = [summed()]
                if len(held[0][0]) > GATHERED_RUNS // 2:
                    yield from sent(list(held.pop()), ["run", "n"])
    if held:
        yield from sent(list(summed()), ["run", "n"])


class QualityModel(NamedTuple):
    """For each order, highest first: runs and their log2 probabilities, contexts and their log2 weights."""

    runs: list[np.ndarray]
    chances: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]


def train_tables(trusted: DataFrame, text_col: str = "text") -> dict[int, tuple[DataFrame, DataFrame]]:
    """Modified Kneser-Ney estimates of each order: a table ``run, p`` and a table ``context, weight``; null texts take no part."""
    spark = trusted.sparkSession
    shape = "run long, n long"
    counts = {ORDER: written(trusted.select(F.col(text_col).alias("_text")).mapInArrow(_counted, shape).groupBy("run").agg(F.sum("n").alias("n")))}
    for k in range(ORDER - 1, 0, -1):
        # A shorter run counts the different bytes seen before it.
        counts[k] = written(counts[k + 1].groupBy(F.col("run").bitwiseAND((1 << 8 * k) - 1).alias("run")).agg(F.count("*").alias("n")))
    below = spark.createDataFrame([(0, 1 / 256)], "run long, p double")
    out = {}
    for k in range(1, ORDER + 1):
        seen = dict(counts[k].where("n <= 4").groupBy("n").count().collect())
        n1, n2, n3, n4 = (seen.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        off = [i - (i + 1) * y * b / a if a and b else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        off = [min(max(d, 0.05), i - 0.05) for i, d in zip((1, 2, 3), off, strict=True)]
        taken = F.when(F.col("n") == 1, off[0]).when(F.col("n") == 2, off[1]).otherwise(off[2])
        table = counts[k].withColumn("context", F.shiftright("run", 8)).withColumn("taken", taken)
        context = table.groupBy("context").agg(F.sum("n").alias("total"), F.sum("taken").alias("left")).select("context", "total", (F.col("left") / F.col("total")).alias("weight"))
        table = table.withColumn("suffix", F.col("run").bitwiseAND((1 << 8 * (k - 1)) - 1))
        lower = below.withColumnsRenamed({"run": "suffix", "p": "q"})
        p = (F.col("n") - F.col("taken")) / F.col("total") + F.col("weight") * F.col("q")
        below = written(table.join(context, "context").join(lower, "suffix").select("run", p.alias("p")))
        out[k] = below, context.select("context", "weight")
    return out


def is_small(tables: dict[int, tuple[DataFrame, DataFrame]]) -> bool:
    """Whether the tables hold at most ``MODEL_ROWS`` runs together, which may be collected."""
    return sum(runs.count() for runs, _ in tables.values()) <= MODEL_ROWS


def collected(tables: dict[int, tuple[DataFrame, DataFrame]]) -> QualityModel:
    """The tables as arrays; their size is checked first."""
    order = range(ORDER, 0, -1)
    if not is_small(tables):
        raise ValueError(f"over {MODEL_ROWS} runs: use score_sharded")
    runs = [tables[k][0].toPandas().sort_values("run") for k in order]
    contexts = [tables[k][1].toPandas().sort_values("context") for k in order]
    return QualityModel(
        [r["run"].to_numpy(np.int64) for r in runs], [np.log2(r["p"].to_numpy()).astype(np.float32) for r in runs],
        [c["context"].to_numpy(np.int64) for c in contexts], [np.log2(c["weight"].to_numpy()).astype(np.float32) for c in contexts],
    )


def train(trusted: DataFrame, text_col: str = "text") -> QualityModel:
    """``train_tables``, collected; an error where they are too large for that."""
    return collected(train_tables(trusted, text_col))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def chance(runs: np.ndarray, model: QualityModel) -> np.ndarray:
    """log2 probability of the last byte of each run after the others, at the longest order that knows it."""
    out = np.zeros(len(runs), np.float32)
    known = np.zeros(len(runs), bool)
    for i, k in enumerate(range(ORDER, 0, -1)):
        short = runs & ((1 << 8 * k) - 1)
        at, found = _find(model.runs[i], short)
        new = found & ~known
        out[new] += model.chances[i][at[new]] if len(model.chances[i]) else 0
        known |= found
        at, found = _find(model.contexts[i], short >> 8)
        use = found & ~known
        out[use] += model.weights[i][at[use]] if len(model.weights[i]) else 0
    out[~known] += -8
    return out


def bits_of(texts: list[bytes | None], model: QualityModel) -> np.ndarray:
    """Mean bits a byte of each text; NaN for null and empty texts."""
    import pandas as pd

    out = []
    for start, end in blocks(texts, SCORED_BYTES):
        codes, at = _codes(texts[start:end])
        place, runs = pd.factorize(codes)
        total = np.concatenate(([0], np.cumsum(chance(runs, model)[place], dtype=np.float64)))
        sizes = np.diff(at)
        with np.errstate(invalid="ignore"):
            out.append(-(total[at[1:]] - total[at[:-1]]) / sizes)
    return np.concatenate(out) if out else np.empty(0)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """The rows of ``docs`` (without their texts if so wanted) with ``_bytes`` and ``_bits``; null and empty texts have null bits.

    Whole texts are scored where they lie.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    kept = [i for i in range(len(docs.columns)) if keep_text or i != at]

    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = encoded(batch.column(at))
            bits = pa.array(bits_of(texts, shared.value), pa.float64(), from_pandas=True)
            sizes = pa.array([len(t) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), sizes, bits], names=[*(batch.schema.names[i] for i in kept), "_bytes", "_bits"])

    return docs.mapInArrow(run, StructType([*(docs.schema.fields[i] for i in kept), StructField("_bytes", LongType()), StructField("_bits", DoubleType())]))


@lean()
def _distinct_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct runs of each block: ``block, run``."""
    for batch in batches:
        for block, sizes, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            texts = unpacked(sizes, body)
            parts = [np.unique(_codes(texts[a:b])[0]) for a, b in blocks(texts)]
            runs = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)
            yield from sent([np.full(len(runs), block), runs], ["block", "run"])


@lean()
def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by block, its texts first and then its runs with their chances: ``_id, _bytes, _bits`` of the block's texts."""

    def flush(ids, sizes, body, runs: list, chances: list, kind) -> pa.RecordBatch:
        known, value = (np.concatenate(x) if x else np.empty(0) for x in (runs, chances))
        order = np.argsort(known)
        known, value = known[order], value[order]
        texts = unpacked(sizes, body)
        bits = []
        for a, b in blocks(texts, SCORED_BYTES):
            codes, at = _codes(texts[a:b])
            total = np.concatenate(([0], np.cumsum(value[np.searchsorted(known, codes)], dtype=np.float64)))
            with np.errstate(invalid="ignore"):
                bits.append(-(total[at[1:]] - total[at[:-1]]) / np.diff(at))
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([max(n, 0) for n in sizes], pa.int64()), pa.array(np.concatenate(bits), from_pandas=True)], names=["_id", "_bytes", "_bits"])

    now, runs, chances, kind = None, [], [], None
    for batch in batches:
        kind = batch.schema.field("ids").type.value_type
        block, run = batch.column(0), batch.column(1)
        texts = np.flatnonzero(run.is_null().to_numpy(zero_copy_only=False))
        edges = [0, *texts.tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            if start in texts and start < end:
                if now:
                    yield flush(*now, runs, chances, kind)
                now, runs, chances = tuple(batch.column(i)[start].as_py() for i in (3, 4, 5)), [], []
                start += 1
            if start < end:
                runs.append(run.slice(start, end - start).to_numpy())
                chances.append(batch.column(2).slice(start, end - start).to_numpy())
    if now:
        yield flush(*now, runs, chances, kind)


def chances(runs: DataFrame, tables: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``run, p`` (log2) of distinct ``run``s, by joins to the sharded tables from the highest order down."""
    out = runs.select("run", F.lit(0.0).alias("p"), F.lit(False).alias("done"))
    for k in range(ORDER, 0, -1):
        short = F.col("run").bitwiseAND((1 << 8 * k) - 1)
        known = tables[k][0].select(F.col("run").alias("_r"), F.log2("p").alias("_p"))
        context = tables[k][1].select(F.col("context").alias("_c"), F.log2("weight").alias("_w"))
        out = out.withColumns({"_r": short, "_c": F.shiftright(short, 8)}).join(known, "_r", "left").join(context, "_c", "left")
        here = F.when(F.col("done"), 0.0).otherwise(F.coalesce("_p", "_w", F.lit(0.0)))
        out = out.select("run", (F.col("p") + here).alias("p"), (F.col("done") | F.col("_p").isNotNull()).alias("done"))
    return out.select("run", F.when(F.col("done"), F.col("p")).otherwise(F.col("p") - 8).cast("float").alias("p"))


def score_sharded(docs: DataFrame, tables: dict[int, tuple[DataFrame, DataFrame]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, _bytes, _bits`` as ``score`` gives them, with tables of any size: nothing is broadcast.

    Texts are packed in blocks; a block asks for each of its distinct runs
    once, whatever their frequency, so no run is hot.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    packed = written(packed_blocks(docs, id_col, text_col))
    asked = packed.select("block", "sizes", "body").mapInArrow(_distinct_runs, "block long, run long")
    answers = asked.join(chances(asked.select("run").distinct(), tables), "run").select("block", "run", "p")
    nothing = {"ids": F.lit(None).cast(f"array<{kind}>"), "sizes": F.lit(None).cast("array<long>"), "body": F.lit(None).cast("binary")}
    texts = packed.select("block", F.lit(None).cast("long").alias("run"), F.lit(None).cast("float").alias("p"), "ids", "sizes", "body")
    rows = texts.unionByName(answers.select("block", "run", "p", *(c.alias(n) for n, c in nothing.items())))
    rows = rows.repartition(shards(spark, packed.count(), 4), "block").sortWithinPartitions("block", F.col("run").asc_nulls_first())
    return rows.mapInArrow(_summed, f"_id {kind}, _bytes long, _bits double").withColumnRenamed("_id", id_col)


def _seat(text_col: str):
    return F.xxhash64(F.col(text_col), F.lit("trusted"))


def _is_held(text_col: str):
    """Texts (with all their copies) that are never trained on."""
    return F.pmod(F.xxhash64(F.col(text_col), F.lit("held")), F.lit(HELD_OUT)) == 0


def trusted_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Every different ``text`` labelled good and not held out, whole and once, however many copies it has.

    Ids and hashes choose one row a text; texts are then shuffled once, to the
    chosen rows, and repeated rows are dropped where they meet.
    """
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    known = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) > 0) & ~_is_held(text_col)).select(F.col(id_col).alias("_id"), _seat(text_col).alias("_h"), F.col(text_col).alias("text"))
    drawn = known.select("_id", "_h").join(good, "_id", "left_semi").groupBy("_h").agg(F.min("_id").alias("_id"))
    return known.join(drawn, ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"]).select("text")


#: The former name.
trusted_sample = trusted_texts


def _with_bits(docs: DataFrame, tables: dict[int, tuple[DataFrame, DataFrame]], keep_text: bool) -> DataFrame:
    """``score`` of the collected tables, or the same columns by ``score_sharded`` where the tables are too large for that.

    The latter scores each different text once and joins the scores to the rows by the text's digest.
    """
    if is_small(tables):
        return score(docs, collected(tables), keep_text=keep_text)
    # Null texts go by their ids, so that they don't meet in one task.
    rows = docs.withColumn("_key", F.coalesce(F.md5(F.col("text").cast("binary")), F.hex(F.xxhash64("doc_id"))))
    bits = score_sharded(rows.where("text is not null").select("_key", "text").dropDuplicates(["_key"]), tables, "_key")
    kept = [c for c in docs.columns if keep_text or c != "text"]
    return rows.join(bits, "_key", "left").select(*kept, F.coalesce("_bytes", F.lit(0)).alias("_bytes"), "_bits")


def _scored(docs: DataFrame, labels: DataFrame, keep_text: bool) -> DataFrame:
    """The rows with ``_bits, _limit, _rejected``.

    Limits are joined by language: a table of up to ``MOST_LIMITS`` languages
    goes to the rows, a larger one is joined as Spark sees fit.
    """
    scored = written(_with_bits(docs.withColumn("_held", _is_held("text")), train_tables(trusted_texts(docs, labels)), keep_text))
    good = labels.where(F.col("quality") == 1).select("doc_id").distinct()
    limit = (F.percentile_approx("_bits", QUANTILE, 10_000) + SLACK).alias("limit")
    rows = scored.where("_held and _bits is not null").join(good, "doc_id", "left_semi")
    pooled = rows.agg(limit).withColumnRenamed("limit", "_rest")
    by = rows.where("lang is not null").groupBy("lang").agg(limit, F.count("*").alias("n")).where(F.col("n") >= LEAST_HELD).select("lang", F.col("limit").alias("_own"))
    by = written(by)
    joined = scored.join(F.broadcast(by) if by.count() <= MOST_LIMITS else by, "lang", "left").join(F.broadcast(pooled)).withColumn("_limit", F.coalesce("_own", "_rest") + START_BITS / F.greatest("_bytes", F.lit(1)))
    bad = F.col("_bits").isNull() | F.coalesce(F.col("_bits") > F.col("_limit"), F.lit(False))
    return joined.withColumn("_rejected", bad)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, lang, bits, perplexity, limit_bits, rejected``.

    Trusted are the documents labelled good; a share of their texts is held
    out of training and sets the limits, all others are trained on.  Documents of a language with few
    held-out texts (or of none) are held to the limit of all held-out ones;
    without any nothing is rejected.  Null and empty texts have no bits and
    are rejected.  A score equal to the limit is kept.  Whole texts of any
    length are scored; equal texts score alike and repeated rows all stay.  An
    empty table gives no row.  Other columns are not read.
    """
    with scratch():
        out = _scored(docs.select("doc_id", "lang", "text"), labels, False)
        return written(_judged(out), keep=True)


def _judged(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "lang", F.col("_bits").alias("bits"), F.pow(F.lit(2.0), "_bits").alias("perplexity"), F.col("_limit").alias("limit_bits"), F.col("_rejected").alias("rejected"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that ``judge`` does not reject, all columns kept; null and empty texts go.  Each row is scored once.

    Columns other than the id, language and text go by other names on the
    way, so they clash with none of the scoring.
    """
    inner = [c if c in ("doc_id", "lang", "text") else f"_x{i}" for i, c in enumerate(docs.columns)]
    kept = _scored(docs.toDF(*inner), labels, True).where("not _rejected")
    return kept.select(*inner).toDF(*docs.columns)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``judge`` over all of ``documents``; odd rows as described there."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
