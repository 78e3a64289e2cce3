"""Toxicity by compression distance.

Two raw-content zstandard dictionaries are trained, one on toxic and one on
ordinary labelled texts.  The toxic one holds windows of toxic texts (a word
each) that more toxic than ordinary texts hold, the most telling ones last
(where matches are cheapest); the ordinary one holds as many bytes of windows
of ordinary texts.  Both end with the same ordinary text, so that only what
sets toxic text apart differs.  A text is cut into short windows; how much
shorter each comes out with the toxic dictionary gives five measures, and a
logistic curve fitted on labelled texts that made neither dictionary turns
them into a score.  The evidence that a window needs to be telling is chosen
on those texts too: of several bounds the one whose curve fits them best.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from virosight.llm.compression import compressor, drawn_windows, plain, window_sizes
from virosight.llm.text import crc_bucket, scratch, written

#: Labelled texts of each class, and characters that a drawn text may have: the bounds of the learned sample.
PER_CLASS, SAMPLE_CHARS = 2_500, 200_000
WINDOW_BYTES, LEVEL = 48, 9
#: Bytes of the ordinary text that both dictionaries end with, and of a window of it; most bytes of a dictionary's own windows, and of one.
SHARED_BYTES, SHARED_WINDOW, OWN_BYTES, OWN_WINDOW = 64_000, 200, 16_000, 12
#: Bytes of a word that is a window; a longer one (as in scripts without spaces) is cut in runs of so many.
WORD_BYTES, RUN = 24, 9
#: Bounds of the standard score of a telling window that are tried; least frequency ratio and toxic texts.
BOUNDS, LEAST_RATIO, LEAST_TEXTS = (3.5, 4.25, 5.0, 6.0, 7.5), 5.0, 3
#: Bytes that a window has to gain to be counted, for each of two counts.
GAINS = (3, 5)
#: Of this many labelled texts of a class one fits the curve and the others make the dictionaries.
HELD = 5
TOXIC_FROM = 0.7


class ToxicityModel(NamedTuple):
    ordinary: bytes
    toxic: bytes
    mean: list[float]
    scale: list[float]
    weights: list[float]


def _windows(text: bytes) -> set[bytes]:
    """Words of a text with the spaces around them; runs of longer words."""
    out = set()
    for w in text.split():
        if len(w) <= WORD_BYTES:
            out.add(b" " + w + b" ")
        else:
            out.update(w[i : i + RUN] for i in range(len(w) - RUN + 1))
    return out


def _telling(toxic: list[bytes], ordinary: list[bytes]) -> list[tuple[float, float, bytes]]:
    """Standard score, log ratio and bytes of the windows that more toxic than ordinary texts hold, at the least of ``BOUNDS``."""
    many, few = Counter(), Counter()
    for counts, texts in ((many, toxic), (few, ordinary)):
        for t in texts:
            counts.update(_windows(t))
    a, b = len(toxic), len(ordinary)
    out = []
    for w, n in many.items():
        p, q = (n + 0.5) / (a + 1), (few[w] + 0.5) / (b + 1)
        if n >= LEAST_TEXTS and p > LEAST_RATIO * q:
            share = (n + few[w] + 1) / (a + b + 2)
            z = (p - q) / np.sqrt(share * (1 - share) * (1 / a + 1 / b))
            if z >= BOUNDS[0]:
                out.append((float(z), float(np.log(p / q)), w))
    return out


def _toxic_content(telling: list[tuple[float, float, bytes]], bound: float) -> bytes:
    """Windows of at least that standard score, most telling for their length last, within ``OWN_BYTES``."""
    out, size = [], 0
    for _, _, w in sorted((x for x in telling if x[0] >= bound), key=lambda x: (-x[1] / (len(x[2]) + 8), x[2])):
        size += len(w)
        if size > OWN_BYTES:
            break
        out.append(w)
    return b"".join(reversed(out)).replace(b"  ", b" ")


def _features(texts: list[bytes], compressors: list) -> np.ndarray:
    """Of each text: 1, largest gain of a window, log counts of windows that gain much and very much, mean gain, log count of windows."""
    n = len(texts)
    owner, (plain_size, toxic_size), _ = window_sizes(texts, WINDOW_BYTES, compressors)
    gain = plain_size - toxic_size
    count = lambda weights=None: np.bincount(owner, weights=weights, minlength=n)
    out = np.ones((n, 6))
    most = np.zeros(n)
    np.maximum.at(most, owner, np.clip(gain, 0, 12))
    out[:, 1] = most
    for k, least in enumerate(GAINS):
        out[:, 2 + k] = np.log1p(count(gain >= least))
    out[:, 4] = count(np.maximum(gain, 0)) / np.maximum(count(), 1)
    out[:, 5] = np.log1p(count())
    return out


def _fitted(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float], list[float], float]:
    """Mean, scale and weights of a ridge-penalised logistic curve, and its mean log loss."""
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[scale == 0] = 0.0, 1.0
    x = (x - mean) / scale
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[0.1] * (x.shape[1] - 1)])
    chance = lambda: 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    for _ in range(50):
        p = chance()
        w = w + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
    p = chance()
    return mean.tolist(), scale.tolist(), w.tolist(), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def learn_toxicity(sample: list[tuple[int, str]]) -> ToxicityModel | None:
    """Train the dictionaries on four fifths of the (label, text) rows and fit the curve on the rest; None if a class is missing.

    A text of both labels counts for both, repeated rows count as often as
    they come; windows of equal worth go in the order of their bytes.  Of
    bounds that fit equally well the first is taken.
    """
    by = {0: [], 1: []}
    for label, text in sample:
        by[int(bool(label))].append(plain(text))
    if min(map(len, by.values())) < 2:
        return None
    toxic, ordinary = ([t for k, t in enumerate(by[c]) if k % HELD] for c in (1, 0))
    held = [by[c][::HELD] for c in (1, 0)]
    base = b" ".join(drawn_windows(ordinary, SHARED_WINDOW, SHARED_BYTES)) + b" "
    telling, y = _telling(toxic, ordinary), np.repeat([1.0, 0.0], [len(held[0]), len(held[1])])
    best, least, before = None, np.inf, None
    for bound in BOUNDS:
        own = _toxic_content(telling, bound)
        if own == before:
            continue
        before = own
        pad = b" ".join(drawn_windows(ordinary, OWN_WINDOW, len(own)))
        contents = pad + b" " + base, own + b" " + base
        *curve, loss = _fitted(_features(held[0] + held[1], [compressor(c, LEVEL) for c in contents]), y)
        if loss < least:
            best, least = ToxicityModel(*contents, *curve), loss
    return best


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[int, str]]:
    """A bounded sample of (label, text): at most ``PER_CLASS`` different whole texts of each class, the ones with the least hashes."""
    with scratch():
        known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) != 0).cast("int").alias("_label")).distinct()
        rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text").between(1, SAMPLE_CHARS)).withColumn("_h", F.xxhash64("_text", F.lit("toxic")))
        # The texts stay behind until it is known which ones are drawn.
        once = written(rows.select("_id", "_h").join(known, "_id").groupBy("_label", "_h").agg(F.min("_id").alias("_id")))
        draw, rate = F.pmod("_h", F.lit(1 << 40)) / float(1 << 40), F.lit(0.0)
        for label, n in once.groupBy("_label").count().collect():
            # Twice what is wanted, so that few rows are ranked and still enough are left.
            rate = F.when(F.col("_label") == label, F.lit(min(1.0, 2.0 * PER_CLASS / n))).otherwise(rate)
        seat = F.row_number().over(Window.partitionBy("_label").orderBy(draw, "_h"))
        drawn = once.where(draw < rate).withColumn("_k", seat).where(F.col("_k") <= PER_CLASS)
        found = rows.join(F.broadcast(drawn), ["_id", "_h"]).select("_label", "_k", "_text").dropDuplicates(["_label", "_k"]).collect()
        return [(label, text) for label, _, text in sorted(found, key=lambda r: (r[0], r[1]))]


_held: dict = {}


def _compressors(model: ToxicityModel) -> list:
    key = hash((model.toxic, model.ordinary))
    if key not in _held:
        _held.clear()
        _held[key] = [compressor(model.ordinary, LEVEL), compressor(model.toxic, LEVEL)]
    return _held[key]


def score_texts(texts: list[str | None], model: ToxicityModel | None) -> np.ndarray:
    """Scores from 0 to 1; 0 for every text if there is no model."""
    if model is None:
        return np.zeros(len(texts))
    x = (_features([plain(t) for t in texts], _compressors(model)) - model.mean) / model.scale
    return 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -500, 500)))


def toxicity_scores(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``id_col, score``.

    Whole texts of any length are scored; a null or empty text has no window
    and gets the score of a text that gains nothing.  Equal texts score alike,
    repeated rows all stay and an empty table gives no row.  Other columns are
    not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"_id {dict(docs.dtypes)[id_col]}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_texts(part.column(1).to_pylist(), shared.value), pa.float64())], names=["_id", "score"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labelled rows that are not held out; odd rows as in ``toxicity_scores``."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn_toxicity(labelled_texts(docs, labels.where(crc_bucket("doc_id", 3) != 1)))
    held_out = (crc_bucket("doc_id", 3) == 1).alias("held_out")
    return toxicity_scores(docs, model).select("doc_id", held_out, "score", F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0).alias("predicted"))
