"""Spelling variants: words one edit apart, found over pivotal bigrams, and the common form that each follows.

Bigrams are ranked by how few words hold them.  A word's prefix is its three
rarest bigrams (and any of the third one's rank); three bigrams always hold
two that share no letter, and the two such of least total frequency are its
pivots, chosen by dynamic programming.  One edit can break only one of two
disjoint bigrams, so a word's neighbour keeps a pivot, shifted by no more than
the edit shifts it.  Of two words, the one whose prefix ends at the rarer rank
has its kept pivot in the other's prefix.  So pivots are looked up in prefixes
alone, under bigram, place and length, and what is met is verified.  No pair
of words one edit apart is lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from virosight.llm.text import discard, encoded, scratch, slices, written

#: Code points of a word, occurrences of it, and how many times as common a form has to be.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One in so many of a document's different runs is misspelled before it is counted.
MISSPELLED = 199
#: Different words that a task counts before it passes their counts on.
HELD_WORDS = 400_000

#: Runs that can become words, once A-Z are lower-cased: 90 letters, hence 8,100 bigrams at most.
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: How length and place of a bigram can differ in a word one edit away: replaced, inserted behind or before it, deleted behind or before it.
_SHIFTS = ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))


def document_words(doc_id: str | None, text: bytes | None) -> Counter:
    """Counts of a document's lower-cased runs, with a letter deleted from one in ``MISSPELLED`` by the run's hash."""
    found = Counter(_RUN.findall((text or b"").translate(_LOWER).decode("utf-8", "replace")))
    start = zlib.crc32(f"{doc_id or ''}:".encode())
    hit = [(w, h) for w in found if (h := zlib.crc32(w.encode(), start)) % MISSPELLED == 0]
    counts = [(w, h, found.pop(w)) for w, h in hit]
    for w, h, n in counts:
        k = h % len(w)
        if len(w) > LEAST_LENGTH:
            found[w[:k] + w[k + 1 :]] += n
    return found


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in slices(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
            counts.update(document_words(doc_id, text))
            if len(counts) > HELD_WORDS:
                yield flush()
    yield flush()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: words of ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences in all texts."""
    parts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(_words, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def pivots(places: list[int], costs: list[int]) -> tuple[int, int]:
    """Two places at least two apart with the least total cost, of ascending places; the first such."""
    best, least, pair = None, None, None
    ahead = 0
    for j, place in enumerate(places):
        # The cheapest of the places that end before this one begins.
        while places[ahead] <= place - 2:
            if least is None or costs[ahead] < costs[least]:
                least = ahead
            ahead += 1
        if least is not None and (best is None or costs[least] + costs[j] < best):
            best, pair = costs[least] + costs[j], (places[least], place)
    if pair is None:
        raise ValueError("no two places are apart")
    return pair


def prefix_and_pivots(word: str, ranks: dict[str, tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int]:
    """Prefix and pivots of a word as (rank, place), and the rank at which the prefix ends; ``ranks`` has rank and frequency of bigrams."""
    grams = [ranks[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(r for r, _ in grams)[2]
    places = [i for i, (r, _) in enumerate(grams) if r <= last]
    two = pivots(places, [grams[i][1] for i in places])
    return [(grams[i][0], i) for i in places], [(grams[i][0], i) for i in two], last


def _postings(ranks: dict[str, tuple[int, int]]):
    """mapInArrow function over words: prefix rows (probe false), and a probe row for each way an edit can shift a pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5000):
            rows = []
            for word in batch.column(0).to_pylist():
                prefix, two, last = prefix_and_pivots(word, ranks)
                rows += [(False, r, i, len(word), last, word) for r, i in prefix]
                rows += [(True, r, i + shift, len(word) + longer, last, word) for r, i in two for longer, shift in _SHIFTS if i + shift >= 0]
            kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], names=["probe", "gram", "place", "length", "last", "word"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """``a, b`` with a < b: every pair of distinct words (column ``word``) exactly one insertion, deletion or replacement apart.

    Words have four letters at least, of a small alphabet: the ranks of all
    bigrams are sent to each task.
    """
    grams = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2))))
    counted = words.select(grams.alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()
    ranks = {g: (rank, n) for rank, (n, g) in enumerate(sorted((n, g) for g, n in counted))}
    posted = written(words.select("word").mapInArrow(_postings(ranks), "probe boolean, gram int, place int, length int, last int, word string"))
    key = ["gram", "place", "length"]
    probes = posted.where("probe").select(*key, F.col("last").alias("own"), F.col("word").alias("a"))
    met = probes.join(posted.where("not probe").select(*key, "last", F.col("word").alias("b")), key).where("own <= last and a <> b")
    near = met.where(F.levenshtein("a", "b", 1) == 1).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return written(near.distinct())


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form (columns ``word, form``): the last word that forms lead to, by doubling."""
    jump = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, jump = jump, written(jump.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(before)
        if jump.where("moved").isEmpty():
            return jump.select("word", "root")
        jump = jump.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    Words are runs of letters with A-Z lower-cased, at least six code points
    long and counted at least five times; a word's form is its most common
    neighbour one edit away (ties: the least word in code-point order) if that
    is five times as common, and its root is where forms end.  A null or empty
    text has no words; a null id counts as an empty one, and rows that share
    an id are documents each.  Repeated rows count each.  Whole texts are
    read, however long.  No word gives no row.  Other columns are not read.
    """
    with scratch():
        words = written(word_counts(docs, id_col, text_col))
        pairs = near_words(words)
        both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
        other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
        best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
        near = both.join(other, "other").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
        rows = words.join(near, "word", "left")
        has_form = -F.col("best.n") >= RATIO * F.col("n")
        rows = written(rows.select("word", F.when(has_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, -F.col("best.n")).alias("form_n")))
        roots = _roots(rows.where("form is not null"))
        return written(rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), keep=True)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents``, their forms and roots; odd rows as in ``variants``."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
