"""Benchmark decontamination with one Aho-Corasick automaton over word windows.

Every run of ``WINDOW`` words of a benchmark item is a window; an item of
fewer words is one window.  The automaton is built over word numbers, so a
document is scanned once, word by word, and each match is a span of whole
words; ``spans`` maps these back to byte offsets in the original text.

The benchmark is the stated query set.  Its items go to the executors in
blocks of at most ``BLOCK_WORDS`` words, so that neither the driver nor a
worker ever holds an automaton of more than that (an item longer than the
bound is a block of its own).  A task gathers ``SPOOL_BYTES`` of text and
searches them with one block after another in the same worker, which holds one
automaton at a time.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from virosight.llm.text import ALNUM, encoded, slices
from virosight.llm.worker import held, lean

WINDOW = 10
#: Words of benchmark items in one automaton, and bytes of text that meet it before the next one is built.
BLOCK_WORDS, SPOOL_BYTES = 200_000, 64 << 20

_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words: ASCII letters and digits and all non-ASCII characters."""
    return text.translate(ALNUM).split() if text else []


class WindowAutomaton:
    """Aho-Corasick automaton over the word windows of some items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words_of(text))
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(ids[i : i + window], set()).add(item)
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ids, who in owners.items():
            self.found.add_word(ids, (len(ids), tuple(sorted(who))))
        self.shortest = min(map(len, owners), default=0)
        self.found.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit spans (first word, word after the last) and the items hit."""
        spans: list[list[int]] = []
        items: set[str] = set()
        if self.shortest and len(words) >= self.shortest:
            get = self.number.get
            for end, (size, who) in self.found.iter(tuple([get(w, 0) for w in words])):
                start = end - size + 1
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = end + 1
                else:
                    spans.append([start, end + 1])
                items.update(who)
        return [(a, b) for a, b in spans], items


def _packed(items: list[tuple[str, bytes]]) -> bytes:
    return zlib.compress(json.dumps([(i, t.decode()) for i, t in items]).encode())


def _automaton(packed: bytes, window: int) -> WindowAutomaton:
    """The automaton of these items; a worker keeps the last one it built."""
    return held("windows", (packed, window), lambda: WindowAutomaton([(i, t.encode()) for i, t in json.loads(zlib.decompress(packed))], window))


def _spooled(batches: Iterator[pa.RecordBatch], text_at: int, blocks: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of batches of about ``SPOOL_BYTES`` of text; a single benchmark block takes no turns, so batches come one by one."""
    held, size = [], 0
    for batch in slices(batches):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(text_at))).as_py() or 0
        if blocks == 1 or size >= SPOOL_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _in_turn(blocks: list, window: int, backwards: bool) -> Iterator[WindowAutomaton]:
    """Automata of all blocks; every other time from the last one, which is still there."""
    for block in reversed(blocks) if backwards else blocks:
        yield _automaton(block.value, window)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """Benchmark items with words, in blocks of at most ``limit`` words, read one partition at a time."""
    block, size = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), text_col).toLocalIterator():
        n = len(words_of(text.encode())) if text and item is not None else 0
        if not n:
            continue
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((item, text.encode()))
        size += n
    if block:
        yield block


def _scanner(blocks: list, window: int, with_offsets: bool):
    """mapInArrow function: ``_id, n_words, spans, items``, and byte offsets if wanted."""

    @lean("windows")
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, held in enumerate(_spooled(batches, 1, len(blocks))):
            rows = [text for batch in held for text in encoded(batch.column(1))]
            spans: list[list[int]] = [[] for _ in rows]
            items: list[set[str]] = [set() for _ in rows]
            counts = np.zeros(len(rows), np.int64)
            for automaton in _in_turn(blocks, window, turn % 2 == 1):
                for i, text in enumerate(rows):
                    words = words_of(text)
                    counts[i] = len(words)
                    found, who = automaton.scan(words)
                    spans[i] += [x for s in found for x in s]
                    items[i] |= who
            done = 0
            for batch in held:
                own = slice(done, done := done + batch.num_rows)
                flat = [_merged(s) for s in spans[own]]
                columns = [batch.column(0), pa.array(counts[own]), pa.array(flat, pa.list_(pa.int64())), pa.array([sorted(x) for x in items[own]], pa.list_(pa.string()))]
                names = ["_id", "n_words", "spans", "items"]
                if with_offsets:
                    columns.append(pa.array([_byte_spans(t, s) for t, s in zip(rows[own], flat, strict=True)], pa.list_(pa.int64())))
                    names.append("byte_spans")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return scan


def _byte_spans(text: bytes | None, spans: list[int]) -> list[int]:
    """Byte offsets in the original text of flat word spans."""
    at = [m.span() for m in _WORD.finditer(text.translate(ALNUM))] if spans else []
    return [x for a, b in zip(spans[::2], spans[1::2], strict=True) for x in (at[a][0], at[b - 1][1])]


def _merged(spans: list[int]) -> list[int]:
    """Flat runs that touching or overlapping flat word spans make."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    with_offsets: bool = False,
) -> DataFrame:
    """One row per document row: ``id_col, n_words, spans, items`` (and ``byte_spans``).

    ``spans`` is a flat array of word numbers start, end, ... of merged hit
    runs, ``items`` the sorted distinct ids (as strings) of items with a
    window in the text; ``byte_spans`` are the same runs as byte offsets in
    the UTF-8 of the original text.  Null and empty texts have no words.
    Items that are null, empty or without an id take no part; an empty
    benchmark hits nothing.  Rows with equal or null ids stay apart,
    whatever the number of blocks.  Other columns are not read.
    """
    schema = f"_id {dict(docs.dtypes)[id_col]}, n_words long, spans array<long>, items array<string>" + (", byte_spans array<long>" if with_offsets else "")
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_scanner(_shared_blocks(benchmark, item_col, item_text_col, block_words), window, with_offsets), schema)
    return out.withColumnRenamed("_id", id_col)


def _shared_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> list:
    """Packed blocks on their way to the workers, one empty block if the benchmark has none."""
    send = benchmark.sparkSession.sparkContext.broadcast
    return [send(_packed(block)) for block in item_blocks(benchmark, item_col, text_col, block_words)] or [send(_packed([]))]


def _covered(spans):
    """Summed lengths of the flat spans start, end, ... of an array column."""
    ends = F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(ends, F.lit(0).cast("long"), lambda a, x: a + x)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of ``contamination`` for every document; ``hit_bytes`` are the bytes of the original text from the first to the last word of each hit run.

    Odd rows as described there: null texts have no words and hit nothing,
    repeated rows all stay, an empty table gives no row.
    """
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark, with_offsets=True).select(
        "doc_id", "n_words", _covered("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), _covered("byte_spans").alias("hit_bytes"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without any benchmark window, all columns kept.

    The scan runs beside the row itself, so there is no join back: rows of
    equal or null ids are each judged by their own text.  Null, empty and
    wordless texts hit nothing and stay; an empty benchmark drops nothing.
    """
    blocks, at = _shared_blocks(benchmark, "item_id", "text", block_words), docs.columns.index(text_col)

    @lean("windows")
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, held in enumerate(_spooled(batches, at, len(blocks))):
            clean = [np.ones(batch.num_rows, bool) for batch in held]
            for automaton in _in_turn(blocks, WINDOW, turn % 2 == 1):
                for batch, flags in zip(held, clean, strict=True):
                    texts = encoded(batch.column(at))
                    for i in np.flatnonzero(flags):
                        flags[i] = not automaton.scan(words_of(texts[i]))[1]
            for batch, flags in zip(held, clean, strict=True):
                yield batch.filter(pa.array(flags))

    return docs.mapInArrow(keep, docs.schema)


_WORDS, _REST = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD_LIST = f"regexp_extract_all({_LOWER_TEXT}, '{_WORDS}')"

ORACLE = f"""
WITH item_words AS (SELECT item_id, {_WORD_LIST} AS w FROM benchmark WHERE item_id IS NOT NULL),
     windows AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS win
                 FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {WINDOW} + 1, 1))) AS i FROM item_words WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT size FROM windows),
     d AS (SELECT doc_id, {_WORD_LIST} AS w FROM documents),
     runs AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
            FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= size)),
     hits AS (SELECT runs.doc_id, runs.i, runs.size, windows.item_id FROM runs JOIN windows USING (size, win)),
     places AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)),
     hit_words AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
     tokens AS (SELECT doc_id, unnest(t) AS t, generate_subscripts(t, 1) AS k
                FROM (SELECT doc_id, regexp_extract_all({_LOWER_TEXT}, '{_WORDS}|{_REST}') AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM places))),
     ends AS (SELECT doc_id, t, k, sum(strlen(t)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM tokens),
     words AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS p, stop - strlen(t) AS start, stop FROM ends WHERE regexp_matches(t, '^{_WORDS}$')),
     islands AS (SELECT doc_id, max(stop) - min(start) AS n
                 FROM (SELECT doc_id, start, stop, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM places JOIN words USING (doc_id, p)) GROUP BY doc_id, island),
     hit_bytes AS (SELECT doc_id, sum(n) AS n FROM islands GROUP BY doc_id),
     hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
                   FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(hit_bytes.n, 0)::BIGINT AS hit_bytes
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id) LEFT JOIN hit_bytes USING (doc_id)
"""
