"""Compressed sizes under zstandard raw-content dictionaries, and bounded labelled samples to make them of."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from virosight.llm.text import ALNUM

#: Segments that go to the compressor in one call.
_CALL = 20_000
#: Stands before each window.  It shrinks to a few bytes in all encodings, so that no
#: window is stored as it is because its own bytes shrink too little.
_PAD = b" " * 24
#: Stands after each window: the encoder starts no match in the last bytes of its input.
_TAIL = b" " * 12


def plain(text: str | None) -> bytes:
    """UTF-8 of the lower-cased words of a text, one space between them."""
    return b" ".join(text.lower().encode().translate(ALNUM).split()) if text else b""


def compressor(content: bytes, level: int):
    """A compressor that starts from ``content`` and writes no header fields."""
    import zstandard

    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)


def cuts(text: bytes, size: int) -> list[tuple[int, int]]:
    """Windows (start, length) of ``size`` bytes, each carried on to the end of its word."""
    out, start, n = [], 0, len(text)
    while start < n:
        end = text.find(b" ", start + size) if start + size < n else n
        end = n if end < 0 else end
        out.append((start, end - start))
        start = end + 1
    return out


def window_sizes(texts: list[bytes], size: int, compressors: Iterable) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Windows of all texts: the text each belongs to, its compressed size with each compressor, and its length."""
    import zstandard

    windows, owner = [], []
    for k, text in enumerate(texts):
        own = cuts(text, size)
        windows += [text[a : a + n] for a, n in own]
        owner += [k] * len(own)
    lengths = np.fromiter(map(len, windows), np.int64, len(windows))
    blob = b"".join([_PAD + w + _TAIL for w in windows])
    full = lengths + len(_PAD) + len(_TAIL)
    table = np.stack([np.cumsum(full) - full, full], 1).astype(np.uint64)
    sizes = []
    for c in compressors:
        parts = []
        for k in range(0, len(table), _CALL):
            got = c.multi_compress_to_buffer(zstandard.BufferWithSegments(blob, table[k : k + _CALL].tobytes()), threads=0)
            parts.append(np.fromiter(map(len, got), np.int64, len(got)))
        sizes.append(np.concatenate(parts) if parts else np.empty(0, np.int64))
    return np.array(owner, np.int64), sizes, lengths


def drawn_windows(texts: Iterable[bytes], size: int, limit: int) -> list[bytes]:
    """Windows of about ``size`` bytes from all places of all texts, in the order of a hash, of ``limit`` bytes together."""
    windows = {text[a : a + n] for text in texts for a, n in cuts(text, size)}
    out, used = [], 0
    for w in sorted(windows, key=lambda w: hashlib.blake2b(w, digest_size=8).digest()):
        if used + len(w) + 1 > limit:
            break
        out.append(w)
        used += len(w) + 1
    return out


def labelled_sample(rows: DataFrame, label_col: str, text_col: str, per_label: int, max_chars: int, max_labels: int) -> list[tuple]:
    """At most ``per_label`` (label, text) rows of each label with whole, different texts, in a fixed order.

    Copies of a text come once, then the texts with the least hashes are
    drawn, so the choice hangs neither on partitions nor on how often a text
    occurs.  Texts of over ``max_chars`` characters aren't drawn, and null
    labels and null or empty texts take no part.  More than ``max_labels``
    labels is an error.
    """
    fits = F.length(text_col).between(1, max_chars)
    known = rows.where(F.col(label_col).isNotNull() & fits).select(F.col(label_col).alias("_label"), F.col(text_col).alias("_text")).withColumn("_h", F.xxhash64("_text", F.lit("sample")))
    counts = known.groupBy("_label").agg(F.approx_count_distinct("_h")).limit(max_labels + 1).collect()
    if len(counts) > max_labels:
        raise ValueError(f"{label_col} has more than {max_labels} values")
    if not counts:
        return []
    draw = F.pmod("_h", F.lit(1 << 40)) / float(1 << 40)
    # Twice what is wanted: the count is an estimate, and the window below cuts the rest.
    rates = rows.sparkSession.createDataFrame([(label, min(1.0, 2.0 * per_label / max(n, 1))) for label, n in counts], StructType([known.schema["_label"], StructField("_rate", DoubleType())]))
    once = known.join(F.broadcast(rates), "_label").where(draw < F.col("_rate")).groupBy("_label", "_h").agg(F.min("_text").alias("_text"))
    seat = F.row_number().over(Window.partitionBy("_label").orderBy(draw, "_h"))
    found = once.withColumn("_k", seat).where(F.col("_k") <= per_label).select("_label", "_k", "_text").collect()
    return [(label, text) for label, _, text in sorted(found, key=lambda r: (str(r[0]), r[1]))]
