"""Language identification by compression.

Each language has a raw-content zstandard dictionary of labelled text.  A text
is encoded in windows with every dictionary, and the language whose sizes sum
to the least is chosen.  If the second best is nearly as small, the choice is
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from virosight.llm.compression import compressor, drawn_windows, labelled_sample, plain, window_sizes
from virosight.llm.text import crc_bucket
from virosight.llm.worker import held, lean

#: Labelled texts of a language, characters that a drawn text may have, and bytes of a dictionary: the bounds of the learned sample.
PER_LANGUAGE, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 200_000, 100_000
#: Bytes of a piece of a dictionary; languages of a model at most; and compressors that a worker holds at once.
PIECE_BYTES, MAX_LANGUAGES, HELD_LANGUAGES = 256, 2_000, 200
WINDOW_BYTES, LEVEL = 1024, 9
#: Bits of difference that count as one unit of evidence in the score.
TEMPER = 4.0
#: A choice is rejected if the second best is larger by a smaller share of the best size, or by fewer bytes, than this.
NARROW, LEAST_MARGIN = 0.02, 2
UNKNOWN = "und"


def learn_languages(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, bytes]:
    """Dictionary content of each language that the rows are labelled with: pieces from all places of a bounded sample of whole texts."""
    parts: dict[str, list[bytes]] = {}
    for lang, text in labelled_sample(rows, lang_col, text_col, PER_LANGUAGE, SAMPLE_CHARS, MAX_LANGUAGES):
        parts.setdefault(str(lang), []).append(plain(text))
    return {lang: b" ".join(drawn_windows(own, PIECE_BYTES, DICTIONARY_BYTES)) + b" " for lang, own in sorted(parts.items())}


def _compressors(model: dict[str, bytes]) -> Iterator[list]:
    """The model's compressors, ``HELD_LANGUAGES`` at a time; a worker keeps those of the last part it used."""
    contents = list(model.values())
    for k in range(0, len(contents), HELD_LANGUAGES):
        some = contents[k : k + HELD_LANGUAGES]
        yield held("languages", hash((k, *some)), lambda some=some: [compressor(c, LEVEL) for c in some])


def classify(texts: list[str | None], model: dict[str, bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text; ``und``, 0 and True for a text without a letter."""
    names = list(model)
    if not names:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    forms = [plain(t) for t in texts]
    columns = []
    for some in _compressors(model):
        owner, sizes, _ = window_sizes(forms, WINDOW_BYTES, some)
        columns += [np.bincount(owner, weights=s, minlength=len(texts)) for s in sizes]
    total = np.stack(columns, 1)
    best = total.argmin(1)
    odds = np.exp(-np.minimum((total - total.min(1, keepdims=True)) * 8 / TEMPER, 700))
    score = 1 / odds.sum(1)
    ordered = np.sort(total, 1)
    narrow = ordered[:, 1] - ordered[:, 0] < np.maximum(LEAST_MARGIN, NARROW * ordered[:, 0]) if len(names) > 1 else np.zeros(len(texts), bool)
    lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
    return [names[b] if has else UNKNOWN for b, has in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0), narrow | ~lettered


def _predictor(model, text_at: int, keep: bool):
    @lean("languages")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                langs, score, rejected = classify(part.column(text_at).to_pylist(), model.value)
                if keep:
                    yield part.filter(pa.array(~rejected))
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=["_id", "lang_pred", "score", "rejected"])

    return run


def predict_languages(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``id_col, lang_pred, score, rejected``.

    A null or empty text, or one without a letter, is ``und`` with score 0
    and rejected; so is every text if no language was learned.  Of languages
    with equal sizes the first by name is chosen, at a score of 1/2 or less,
    and rejected, as is every choice with a narrow margin; the margin is held
    against the size of the text.  With one language there is no second best.
    Whole texts of any length are encoded.  Repeated rows all stay, an empty
    table gives no row, and other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"_id {dict(docs.dtypes)[id_col]}, lang_pred string, score double, rejected boolean"
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_predictor(shared, 1, False), schema).withColumnRenamed("_id", id_col)


def keep_identified(docs: DataFrame, model: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows whose language is identified by a margin that is not narrow, all columns kept.

    Null, empty and letterless texts go.  With an empty model there is no
    language to identify, and every row stays.
    """
    if not model:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predictor(shared, docs.columns.index(text_col), True), docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows whose language may be learned from."""
    return docs.where(crc_bucket("doc_id", 4) != 2)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out; odd rows as in ``predict_languages``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict_languages(docs, learn_languages(training_rows(docs)))
    return out.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
