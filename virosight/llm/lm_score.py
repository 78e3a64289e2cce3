"""Stupid-backoff language-model scores from n-gram counts over all documents.

Counts and scores are one relational job.  Texts are packed in blocks.  Each
block sends its distinct n-grams with their counts to the shard of the n-gram
hash; the shard adds the blocks' counts up to the table partition of those
n-grams and joins the totals back to the blocks that asked; each block then
scores its documents.  An n-gram comes at most once from a block however often
the block holds it, so frequent n-grams weigh no more than rare ones.

``S(w | context)`` is the count of context and word over the count of the
context if the n-gram occurs ``MIN_COUNT`` times at least, else ``BACKOFF``
times the score with a context one word shorter; a word alone scores its share
of all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from virosight.llm.text import ALNUM, PACK_BYTES, blocks, gram_hashes, packed_blocks, shards, unpacked, word_hashes, written

ORDER, BACKOFF, MIN_COUNT = 2, 0.4, 2
#: N-grams of a shard at most on average.
SHARD_GRAMS = 2_500_000


def _words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the place of each word in its text."""
    hashes, places = [], []
    for start, end in blocks(texts):
        h, at = word_hashes(texts[start:end], ALNUM)
        hashes.append(h)
        places.append(np.arange(len(h)) - np.repeat(at[:-1], np.diff(at)))
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _grams(words: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes that end at the words that have ``n - 1`` words before them, and those words' positions."""
    ends = np.flatnonzero(places >= n - 1)
    return (words if n == 1 else gram_hashes(words, n))[ends - (n - 1)] if len(ends) else np.empty(0, np.uint64), ends


def _shard(grams: np.ndarray, count: int) -> np.ndarray:
    """Ranges of the hash, so that sorted hashes have sorted shards."""
    return ((grams >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def _asker(order: int, count: int):
    """mapInArrow function: distinct n-grams of each block by shard, ``shard, block, n, grams, counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words, places = _words(unpacked(sizes, body))
                for n in range(1, order + 1):
                    grams, counts = np.unique(_grams(words, places, n)[0], return_counts=True)
                    own = _shard(grams, count)
                    edges = np.searchsorted(own, np.arange(count + 1))
                    rows = [(s, edges[s], edges[s + 1]) for s in np.unique(own).tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r[0] for r in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array([n] * len(rows), pa.int64()),
                            pa.array([grams[a:b].tobytes() for _, a, b in rows], pa.binary()),
                            pa.array([counts[a:b].astype(np.uint32).tobytes() for _, a, b in rows], pa.binary()),
                        ],
                        names=["shard", "block", "n", "grams", "counts"],
                    )

    return run


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by shard and order: the totals of each row's n-grams, ``block, n, shard, totals``."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    held: list[tuple[int, bytes, bytes]] = []
    at: tuple[int, int] | None = None

    def flush() -> pa.RecordBatch:
        grams = [np.frombuffer(g, np.uint64) for _, g, _ in held]
        edges = np.cumsum([len(g) for g in grams])[:-1]
        every = np.concatenate(grams)
        counts = np.concatenate([np.frombuffer(c, np.uint32) for _, _, c in held])
        _, which = np.unique(every, return_inverse=True)
        totals = np.bincount(which, weights=counts)[which].astype(np.uint64)
        out = [squeeze.compress(t.tobytes()) for t in np.split(totals, edges)]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in held], pa.int64()), pa.array([at[1]] * len(held), pa.int64()), pa.array([at[0]] * len(held), pa.int64()), pa.array(out, pa.binary())], names=["block", "n", "shard", "totals"])

    for batch in batches:
        for shard, block, n, grams, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and at != (shard, n):
                yield flush()
                held.clear()
            at = shard, n
            held.append((block, grams, counts))
    if held:
        yield flush()


def _scorer(order: int, backoff: float, least: int, total: int):
    """Over rows sorted by block, its texts first: ``_id, n_tokens, n_backoff, log10_score``."""

    def scores(ids, sizes, body, found: dict[int, list[np.ndarray]], kind) -> pa.RecordBatch:
        texts = unpacked(sizes, body)
        words, places = _words(texts)
        counts: list[np.ndarray] = [np.full(len(words), max(total, 1), np.uint64)]
        for n in range(1, order + 1):
            grams, ends = _grams(words, places, n)
            own = np.zeros(len(words), np.uint64)
            if len(ends):
                own[ends] = np.concatenate(found[n])[np.unique(grams, return_inverse=True)[1]]
            counts.append(own)
        value = np.full(len(words), np.nan)
        backed = np.zeros(len(words), np.int64)
        penalty = np.zeros(len(words))
        for n in range(order, 0, -1):
            open_ = np.isnan(value) & (places >= n - 1)
            good = open_ & (counts[n] >= (least if n > 1 else 1))
            context = counts[n - 1] if n == 1 else np.concatenate(([1], counts[n - 1][:-1]))
            value[good] = penalty[good] + np.log10(counts[n][good]) - np.log10(context[good])
            if n > 1:
                missed = open_ & ~good
                penalty[missed] += np.log10(backoff)
                backed[missed] = 1
        owner = np.cumsum(places == 0) - 1
        many = np.zeros(len(texts), np.int64)
        for start, end in blocks(texts):
            many[start:end] = np.diff(word_hashes(texts[start:end], ALNUM)[1])
        worded = np.flatnonzero(many)
        sums, backs = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        sums[worded] = np.bincount(owner, weights=value, minlength=len(worded)) if len(worded) else 0
        backs[worded] = np.bincount(owner, weights=backed, minlength=len(worded)).astype(np.int64) if len(worded) else 0
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(many), pa.array(backs), pa.array(sums)], names=["_id", "n_tokens", "n_backoff", "log10_score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        now, found, kind = None, {}, None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for block, n, _, ids, sizes, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n == 0:
                    if now:
                        yield scores(*now, found, kind)
                    now, found = (ids, sizes, data), {}
                else:
                    found.setdefault(n, []).append(np.frombuffer(expand.decompress(data), np.uint64))
        if now:
            yield scores(*now, found, kind)

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """One row per row: ``id_col, n_tokens, n_backoff, log10_score``.

    Words are runs of ASCII letters (lower-cased), digits and non-ASCII
    characters; counts are over all rows, copies included.  ``n_backoff``
    counts the words scored below the highest order though they have enough
    words before them.  A null, empty or wordless text has no tokens and
    scores 0.  Repeated rows all stay; other columns are not read.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    packed = written(packed_blocks(docs, id_col, text_col, PACK_BYTES))
    total = packed.agg(F.sum("words")).first()[0] or 0
    count = shards(spark, total * order, SHARD_GRAMS)
    asked = packed.select("block", "sizes", "body").mapInArrow(_asker(order, count), "shard long, block long, n long, grams binary, counts binary")
    asked = asked.repartition(count, "shard").sortWithinPartitions("shard", "n")
    totals = asked.mapInArrow(_counter, "block long, n long, shard long, totals binary")
    texts = packed.select("block", F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("shard"), "ids", "sizes", F.col("body").alias("data"))
    answers = totals.select("block", "n", "shard", F.lit(None).cast(f"array<{kind}>").alias("ids"), F.lit(None).cast("array<long>").alias("sizes"), F.col("totals").alias("data"))
    rows = texts.unionByName(answers).repartition(count, "block").sortWithinPartitions("block", "n", "shard")
    return rows.mapInArrow(_scorer(order, backoff, min_count, total), f"_id {kind}, n_tokens long, n_backoff long, log10_score double").withColumnRenamed("_id", id_col)


def ngrams(docs: DataFrame, text_col: str, order: int) -> DataFrame:
    """``row, at, n, gram, context``: every n-gram of every row by its hash, with that of the words before its last."""
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    own = docs.select("row", words.alias("w")).where(F.size("w") > 0)

    def ending(i):
        sizes = F.sequence(F.lit(1), F.least(i, F.lit(order)))
        return F.transform(sizes, lambda n: F.struct(i.alias("at"), n.alias("n"), F.xxhash64(F.slice("w", i - n + 1, n)).alias("gram"), F.xxhash64(F.slice("w", i - n + 1, n - 1)).alias("context")))

    found = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), ending))
    return own.select("row", F.explode(found).alias("g")).select("row", "g.*")


def score_relational(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """The same result as ``score_documents`` by tables alone, for corpora whose n-grams may all be shuffled.

    Count tables of n-grams, dealt by hash, are joined to the exploded n-grams
    and to their contexts; the highest order that counts is taken for each
    word and summed for each document.
    """
    rows = written(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("row")))
    grams = ngrams(rows, "_text", order)
    counts = written(grams.groupBy("n", "gram").agg(F.count("*").alias("c")))
    total = F.lit(counts.where("n = 1").agg(F.sum("c")).first()[0] or 1)
    before = counts.select((F.col("n") + 1).alias("n"), F.col("gram").alias("context"), F.col("c").alias("cc"))
    met = grams.join(counts, ["n", "gram"]).join(before, ["n", "context"], "left")
    least = F.when(F.col("n") > 1, F.lit(min_count)).otherwise(F.lit(1))
    value = F.log10("c") - F.log10(F.when(F.col("n") > 1, F.col("cc")).otherwise(total))
    best = met.groupBy("row", "at").agg(F.max("n").alias("top"), F.max(F.when(F.col("c") >= least, F.struct("n", value.alias("v")))).alias("b"))
    score = F.col("b.v") + (F.col("top") - F.col("b.n")) * F.log10(F.lit(backoff))
    sums = best.groupBy("row").agg(F.count("*").alias("n_tokens"), F.sum((F.col("b.n") < F.col("top")).cast("long")).alias("n_backoff"), F.sum(score).alias("log10_score"))
    zero = F.lit(0).cast("long")
    return rows.join(sums, "row", "left").select(
        F.col("_id").alias(id_col), F.coalesce("n_tokens", zero).alias("n_tokens"), F.coalesce("n_backoff", zero).alias("n_backoff"), F.coalesce("log10_score", F.lit(0.0)).alias("log10_score")
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score_documents`` over all of ``documents``, and the score a word; odd rows as described there."""
    out = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_tokens", "n_backoff", F.round("log10_score", 4).alias("log10_score"), F.round(F.col("log10_score") / F.greatest("n_tokens", F.lit(1)), 6).alias("log10_per_token"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS prev FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0)),
u AS (SELECT word, count(*) AS n FROM t GROUP BY word),
b AS (SELECT prev, word, count(*) AS n FROM t WHERE prev IS NOT NULL GROUP BY prev, word),
s AS (SELECT t.doc_id, CASE WHEN t.prev IS NOT NULL AND b.n < 2 THEN 1 ELSE 0 END AS backed,
             CASE WHEN t.prev IS NULL THEN log10(u.n::DOUBLE) - log10((SELECT sum(n) FROM u)::DOUBLE)
                  WHEN b.n >= 2 THEN log10(b.n::DOUBLE) - log10(p.n::DOUBLE)
                  ELSE log10(0.4::DOUBLE) + log10(u.n::DOUBLE) - log10((SELECT sum(n) FROM u)::DOUBLE) END AS v
      FROM t JOIN u ON t.word = u.word LEFT JOIN u p ON t.prev = p.word LEFT JOIN b ON t.prev = b.prev AND t.word = b.word),
a AS (SELECT doc_id, count(*) AS n_tokens, sum(backed) AS n_backoff, sum(v) AS v FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(n_backoff, 0)::BIGINT AS n_backoff, round(coalesce(v, 0.0), 4)::DOUBLE AS log10_score,
       round(coalesce(v, 0.0) / greatest(coalesce(n_tokens, 0), 1), 6)::DOUBLE AS log10_per_token
FROM d LEFT JOIN a USING (doc_id)"""
