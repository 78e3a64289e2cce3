"""Spelling variants against plain code."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from virosight.llm import spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edits(word, letters):
    """All texts one edit away."""
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}
    return out - {word}


def plain_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    letters = sorted({c for w in n for c in w})
    near = {w: sorted(edits(w, letters) & n.keys()) for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def texts_of(rng):
    bases = ["".join(rng.choice("abcÉéÿ") for _ in range(rng.randint(5, 9))) for _ in range(20)]
    words = []
    for base in bases:
        words += [base] * rng.choice([40, 200])
        for _ in range(6):
            words += [rng.choice(sorted(edits(base, "abcé")))] * rng.choice([4, 5, 6, 8, 40])
    words += ["aaaaaa"] * 200 + ["aaaaaaa"] * 30 + ["aaaaaaaa"] * 6 + ["ababab"] * 9 + ["Ababa"] * 9 + ["abababab"] * 5
    rng.shuffle(words)
    texts = [" ".join(words[i : i + 40]) + "1, x" for i in range(0, len(words), 40)]
    return [*texts, None, "", "12 34", "short", "abcdefg " * 20_000]


def test_variants_against_plain_code(spark, monkeypatch):
    rng = random.Random(4)
    rows = list(enumerate(texts_of(rng)))
    rows += [(None, rows[0][1]), rows[1], (1, rows[2][1]), (None, None)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).withColumns({"word": F.lit("clash"), "n": F.lit(0), "id": F.lit("x")})
    want = plain_variants(rows)
    assert len({w[2] for w in want}) < len(want) and any(w[1] and w[1] != w[2] for w in want)
    for held in (10, spelling.HELD_WORDS):
        monkeypatch.setattr(spelling, "HELD_WORDS", held)
        got = spelling.variants(docs)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(tuple(r) for r in got.collect()) == want


def test_near_words_lose_no_pair(spark):
    """Words of few letters share all their bigrams: still every pair one edit apart is met."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(6, 8))) for _ in range(300)} | {"".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(100)})
    got = {tuple(r) for r in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    held = set(words)
    assert got == {(w, o) for w in words for o in edits(w, "abcdefghij") & held if w < o}


def test_misspelled_runs():
    words = [f"wörter{a}{b}{c}" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefgh"]
    got = spelling.document_words("7", " ".join(words).encode())
    want = Counter()
    for w in words:
        h = zlib.crc32(f"7:{w}".encode())
        want[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    assert got == want and sum(len(w) == 8 for w in got) > 0


@pytest.mark.parametrize(("places", "costs", "want"), [([0, 1, 2], [9, 1, 9], (0, 2)), ([0, 1, 3], [5, 1, 2], (1, 3)), ([0, 2, 5], [1, 1, 1], (0, 2)), ([0, 2, 5, 9], [9, 4, 3, 2], (5, 9))])
def test_pivots(places, costs, want):
    assert spelling.pivots(places, costs) == want
    pairs = [(costs[i] + costs[j]) for j in range(len(places)) for i in range(j) if places[j] - places[i] >= 2]
    assert costs[places.index(want[0])] + costs[places.index(want[1])] == min(pairs)


def test_no_word(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).collect() == []


def test_query_on_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in spelling.op13_spelling_variants(spark, sf).collect()) == plain_variants(rows)
