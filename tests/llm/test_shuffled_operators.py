"""Near duplicates, language-model scores and nearest neighbours against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from virosight.llm import ann, lm_score, near_dups, setsketch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([((ids or range(len(texts)))[i], t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts, percent):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_against_brute_force(spark, percent):
    rng = random.Random(percent)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " \n\t", "one two", "One  TWO", "one two three", "É x"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 150))]
        texts.append(" ".join(base))
        texts += [" ".join(base).upper()] * 2
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40)) + rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts.append(" ".join(word() for _ in range(30_000)))
    roots, sizes = brute_components(texts, percent)
    docs = docs_of(spark, texts).withColumns({"component_id": F.lit("clash"), "key": F.lit(1)})
    got = {r["doc_id"]: r for r in near_dups.near_duplicates(docs, percent=percent).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == roots
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["kept"] for i in range(len(texts))] == [i == r for i, r in enumerate(roots)]
    kept = near_dups.drop_near_duplicates(docs, percent=percent)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots))


def test_tiles_find_the_same(spark, monkeypatch):
    rng = random.Random(9)
    base = [str(rng.random()) for _ in range(80)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(80)] = str(rng.random())
        texts.append(" ".join(copy))
    want, _ = brute_components(texts, 85)
    monkeypatch.setattr(near_dups, "TILE", 5)
    monkeypatch.setattr(near_dups, "PROBES", 3)
    monkeypatch.setattr(near_dups, "CENTRES", 1)
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(docs_of(spark, texts), percent=85).collect()}
    assert [got[i] for i in range(60)] == want


def test_near_duplicates_on_one_far_member_of_a_star(spark):
    rng = random.Random(0)
    texts = []

    def edited(words, at):
        return [str(rng.random()) if i in at else w for i, w in enumerate(words)]

    for _ in range(15):
        base = [str(rng.random()) for _ in range(200)]
        near = edited(base, {100})
        group = [edited(base, {8 + 6 * k, 14 + 6 * k}) for k in range(12)] + [near, edited(near, {115, 135, 155})]
        texts += [" ".join(g) for g in group]
    want, _ = brute_components(texts, 85)
    assert len(set(want)) == 15
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(docs_of(spark, texts), percent=85).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_in_groups_near_the_threshold(spark):
    rng = random.Random(11)

    def edited(words, k):
        return [str(rng.random()) if i in rng_at else w for rng_at in [set(rng.sample(range(len(words)), k))] for i, w in enumerate(words)]

    texts = []
    for _ in range(60):
        base = [str(rng.random()) for _ in range(150)]
        texts += [" ".join(edited(base, rng.randint(2, 4))) for _ in range(4)]
        pair = edited(base, 2)
        texts += [" ".join(pair), " ".join(edited(pair, 2))]
    want, _ = brute_components(texts, 85)
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(docs_of(spark, texts), percent=85).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < len(texts)


def test_words_of_a_long_text_do_not_hang_on_ranges(monkeypatch):
    from virosight.llm import text

    texts = [b"a bb ccc " * 50 + b"x" * 300, None, b"", b"bb"]
    want, at = text.word_hashes(texts, text.SPACED)
    monkeypatch.setattr(text, "BLOCK_BYTES", 64)
    got, same = text.word_hashes(texts, text.SPACED)
    assert (want == got).all() and (at == same).all()


def test_near_duplicates_odd_tables(spark):
    docs = docs_of(spark, ["a b c d e f", "a b c d e f", "x"], [None, 4, 4])
    out = near_dups.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] is None, r["component_id"] or -1, r["kept"]) for r in out) == [(False, 4, True), (False, 4, True), (True, -1, True)]
    assert near_dups.near_duplicates(docs.limit(0)).count() == 0
    assert near_dups.drop_near_duplicates(docs).count() == 3


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).selectExpr("id as a", "id + 1 as b")
    assert {(r["node"], r["root"]) for r in near_dups.components(edges).collect()} == {(i, 0) for i in range(1, 61)}


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(0)
    pairs = []
    for _ in range(40):
        e = rng.integers(0, 2**63, 230, dtype=np.uint64)
        pairs += [e[:200], e[30:]]
    regs = setsketch.sketch(np.concatenate(pairs), np.repeat(np.arange(80), 200), 80)
    n = np.full(40, 200.0)
    assert abs(setsketch.estimate(regs[::2], regs[1::2], n, n).mean() - 170 / 230) < 0.02
    union = setsketch.sketch(np.concatenate([np.union1d(pairs[0], pairs[1])]), np.zeros(230, int), 1)
    assert (np.maximum(regs[0], regs[1]) == union[0]).all()


def brute_scores(texts, order, backoff, least):
    words = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    counts = Counter(tuple(w[i : i + n]) for w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words))
    out = []
    for w in words:
        score, backed = 0.0, 0
        for i in range(len(w)):
            top = min(order, i + 1)
            for n in range(top, 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if counts[gram] >= (least if n > 1 else 1):
                    score += math.log10(counts[gram] / (counts[gram[:-1]] if n > 1 else total)) + (top - n) * math.log10(backoff)
                    backed += n < top
                    break
        out.append((len(w), backed, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_brute_force(spark, order, monkeypatch):
    rng = random.Random(order)
    texts = [" ".join(rng.choice(["the", "Of", "é", "a1", "zz", "q"]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "...", "a " * 5000, "the the", "the the"]
    monkeypatch.setattr(lm_score, "PACK_BYTES", 500)
    docs = docs_of(spark, texts).withColumn("block", F.lit("clash"))
    got = {r["doc_id"]: (r["n_tokens"], r["n_backoff"], r["log10_score"]) for r in lm_score.score_documents(docs, order=order).collect()}
    for i, (n, backed, score) in enumerate(brute_scores(texts, order, 0.4, 2)):
        assert got[i][:2] == (n, backed) and abs(got[i][2] - score) < 1e-6
    assert lm_score.score_documents(docs.limit(0)).count() == 0
    tables = {r["doc_id"]: (r["n_tokens"], r["n_backoff"], r["log10_score"]) for r in lm_score.score_relational(docs, order=order).collect()}
    assert set(tables) == set(got) and all(tables[i][:2] == got[i][:2] and abs(tables[i][2] - got[i][2]) < 1e-6 for i in got)


def cosines(x, q):
    x, q = np.array(x, float), np.array(q, float)
    return x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)


def recall_of(out, ids, x, k=5):
    """Share of the exact neighbours found; scores are checked on the way."""
    by = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r)
    hits = 0
    for q, v in by.items():
        s = cosines(x, x[np.flatnonzero(ids == q)[0]])
        assert [r["rank"] for r in v] == list(range(1, len(v) + 1))
        assert all(abs(s[np.flatnonzero(ids == r["vec_id"])[0]] - r["score"]) < 1e-9 for r in v)
        s[ids == q] = -2
        hits += len({r["vec_id"] for r in v} & set(ids[np.lexsort((ids, -s.round(12)))[:k]].tolist()))
    return hits / (k * len(by)), by


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 32)).round(3)
    x[100:400] = x[100]
    odd = [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] + [1.0] * 31), (2003, [float("inf")] * 32), (2004, [1.0, None]), (2005, []), (2006, [1.0] * 3), (None, x[0].tolist())]
    short = [(2050, [1.0, 0.0, 2.0]), (2051, [1.0, 0.5, 2.0]), (2050, [1.0, 0.0, 2.0])]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd + short
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, part int")
    out = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    # A repeated query row is a candidate like any other, and so is a short vector for short ones.
    assert [r[:3] for r in out if r[0] == 2050] == [(2050, 1, 2050), (2050, 2, 2051), (2050, 3, 2006)]
    x32 = x.astype(np.float32).astype(float)
    recall, by = recall_of([dict(zip(("query_id", "rank", "vec_id", "score"), r)) for r in out if r[0] < 900], np.arange(900), x32)
    assert recall >= 0.9 and sorted(by) == list(range(0, 900, 50))
    assert [r["vec_id"] for r in by[200]] == [100, 101, 102, 103, 104]
    few = ann.nearest(df.where("vec_id in (0, 1, 2)"), F.lit(True))
    assert few.count() == 6 and ann.nearest(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("size", [64, 256])
def test_neighbours_recall_over_several_parts(spark, size, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 1000)
    rng = np.random.default_rng(size)
    x = rng.normal(size=(6000, size)).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4)
    recall, by = recall_of(ann.nearest(df, F.col("vec_id") % 50 == 0).collect(), np.arange(6000), x.astype(float))
    assert recall >= 0.9 and len(by) == 120
