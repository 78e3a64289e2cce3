"""Word splitting and hashing on UTF-8 blocks, vectorised over many texts.

The kernels work on blocks: the texts of some rows, normalised byte by byte
and joined with one space.  A block holds about ``BLOCK_BYTES`` of text; only
a single longer text makes a longer block, since texts are never cut.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from virosight.session import dropped as discard  # noqa: F401
from virosight.session import saved as written  # noqa: F401
from virosight.session import scratch  # noqa: F401

#: Bytes of a block of a kernel, and of a packed block that travels.
BLOCK_BYTES, PACK_BYTES = 2 << 20, 12 << 20

_LOWER = {c: c + 32 for c in range(65, 91)}


def byte_table(is_word) -> bytes:
    """256-byte table that lower-cases A-Z and maps bytes outside words to a space."""
    return bytes(low if is_word(low := _LOWER.get(c, c)) else 32 for c in range(256))


#: Words of ASCII letters, digits and any non-ASCII character.
ALNUM = byte_table(lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128)
#: Words of anything but space, tab, line feed, vertical tab, form feed, return.
SPACED = byte_table(lambda c: not (c == 32 or 9 <= c <= 13))

_PRIME = 0x9E3779B97F4A7C15 | 1
_PRIME_INV = pow(_PRIME, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, ``n`` at least; only tables of a block's size are held."""
    if len(_powers[0]) < n:
        tables = []
        for base in (_PRIME, _PRIME_INV):
            table = np.full(max(n, BLOCK_BYTES + 2), base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        if n > BLOCK_BYTES + 2:
            return tables
        _powers[:] = tables
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encoded(column) -> list[bytes | None]:
    """UTF-8 of an Arrow string column, without decoding it."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def blocks(texts: list[bytes | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold about ``limit`` bytes, one row at least."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) + 1 if t else 1
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def slices(batches, rows: int = 500) -> Iterator:
    """Arrow batches of at most ``rows`` rows: what a task copies out of a batch at once stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _cuts(joined: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of about ``BLOCK_BYTES`` that end behind a space; a longer word is a range of its own."""
    start = 0
    while start < len(joined):
        end = min(start + BLOCK_BYTES, len(joined))
        if end < len(joined):
            end = joined.rfind(b" ", start, end) + 1 or joined.find(b" ", end) + 1
        yield start, end
        start = end


def word_hashes(texts: list[bytes | None], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the offsets where each text's words start.

    Text ``i`` has the words ``offsets[i]:offsets[i + 1]``; a null text has
    none.  A word's hash doesn't hang on its place, so a long text is hashed
    range by range and takes no more working memory than a short one.
    """
    joined = b" ".join([t or b"" for t in texts]).translate(table) + b" "
    whole = np.frombuffer(joined, np.uint8)
    hashes, places = [], []
    for low, high in _cuts(joined):
        data = whole[low:high]
        word = data != 32
        edges = np.flatnonzero(np.diff(np.concatenate(([False], word))))
        starts, ends = edges[::2], edges[1::2]
        powers, inverse = _power_tables(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data.astype(np.uint64) * powers[: len(data)], out=total[1:])
        hashes.append(mix((total[ends] - total[starts]) * inverse[starts]))
        places.append(starts + low)
    starts = np.concatenate(places)
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    offsets = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    offsets[-1] = len(starts)
    return np.concatenate(hashes), offsets


_GRAM = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; the last ``n - 1`` positions have none."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    size = len(hashes) - n + 1
    total = hashes[:size].copy()
    for k in range(1, n):
        total *= _GRAM
        total += hashes[k : k + size]
    return mix(total)


def shards(spark: SparkSession, rows: int, each: int) -> int:
    """A count of shuffle partitions that holds ``each`` rows in a partition, growing with the rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / each))


def crc_bucket(column: str, modulus: int):
    """crc32 of a column as text, modulo ``modulus``; a null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def _packer(limit: int):
    """mapInArrow function that gathers (id, text) rows to blocks of about ``limit`` text bytes."""

    def pack(ids: list, texts: list[bytes | None], kind: pa.DataType, squeeze) -> pa.RecordBatch:
        words = 0
        for start, end in blocks(texts):
            data = np.frombuffer(b" ".join([b"", *(t or b"" for t in texts[start:end])]).translate(ALNUM), np.uint8) != 32
            words += int((data[1:] & ~data[:-1]).sum())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([ids], pa.list_(kind)),
                pa.array([[-1 if t is None else len(t) for t in texts]], pa.list_(pa.int64())),
                pa.array([squeeze.compress(b"".join(t or b"" for t in texts))], pa.binary()), pa.array([words], pa.int64()),
            ],
            names=["block", "ids", "sizes", "body", "words"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        ids, texts, size, kind = [], [], 0, None
        for batch in batches:
            kind = batch.schema.types[0]
            for i, t in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
                if texts and size + len(t or b"") > limit:
                    yield pack(ids, texts, kind, squeeze)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t or b"")
        if texts:
            yield pack(ids, texts, kind, squeeze)

    return run


def unpacked(sizes: list[int], body: bytes) -> list[bytes | None]:
    import zstandard

    whole = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, sum(n for n in sizes if n > 0)))
    ends = np.cumsum([max(n, 0) for n in sizes])
    return [None if n < 0 else whole[e - n : e] for n, e in zip(sizes, ends.tolist(), strict=True)]


def packed_blocks(docs: DataFrame, id_col: str, text_col: str, limit: int = PACK_BYTES) -> DataFrame:
    """Rows ``block, ids, sizes, body, words`` of about ``limit`` text bytes each, the texts compressed in one body."""
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_packer(limit), f"block long, ids array<{kind}>, sizes array<long>, body binary, words long")
