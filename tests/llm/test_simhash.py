"""SimHash fingerprints and components against plain code."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from virosight.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, radius):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, p in zip(ids, prints, strict=True):
        for j, q in zip(ids, prints, strict=True):
            if j < i and (p ^ q).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in ids]


def texts_of(rng):
    word = lambda: "".join(rng.choice("abcdéfgh") for _ in range(4))
    texts = [None, "", " \n\t", "one two", "One  TWO", "one two three", "É x", "\x1c a\xa0b c d"]
    for _ in range(10):
        base = [word() for _ in range(rng.randint(3, 400))]
        texts += [" ".join(base), "\n ".join(base).upper().replace("É", "é")]
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts.append(" ".join(word() for _ in range(30_000)))
    return texts


def test_fingerprints_equal_plain_code():
    texts = texts_of(random.Random(1))
    got = simhash.fingerprints([t.encode() if t is not None else None for t in texts]).tolist()
    assert got == [plain_fingerprint(t) for t in texts]
    assert simhash.fingerprints([]).tolist() == [] and simhash.fingerprints([None]).tolist() == [0]


@pytest.mark.parametrize("radius", [0, 2, 3])
@pytest.mark.parametrize("cut", [1, 1 << 20])
def test_tiles_lose_no_link(monkeypatch, radius, cut):
    """Spanning links give the components that all pairs give, with and without blocks by byte counts."""
    monkeypatch.setattr(simhash, "CUT", cut)
    rng = random.Random(radius)
    prints = [rng.getrandbits(64) for _ in range(30)]
    prints += [p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in prints for _ in range(10)]
    prints = sorted(set(prints))
    x = np.array(prints, np.uint64)
    a, b = simhash.tile_links(x, x, radius)
    assert (np.bitwise_count(x[:, None] ^ x[None, :]) <= radius).sum() >= len(a) + len(x) if radius == 0 else len(a)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        u, v = sorted((find(u), find(v)))
        root[v] = u
    assert [find(p) for p in prints] == plain_components(prints, prints, radius)


@pytest.mark.parametrize("tile", [3, simhash.TILE])
def test_groups_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    texts = texts_of(random.Random(2))
    prints = [plain_fingerprint(t) for t in texts]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    # A repeated row, two rows of one id with different texts, and rows without an id.
    rows += [rows[9], (9, "something else altogether here", "en", "s", 0), (None, texts[9], "en", "s", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"print": F.lit("clash"), "cell": F.lit(1), "id": F.lit(2), "salt": F.lit("x")})
    got = simhash.simhash_groups(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    got = [tuple(r) for r in got.collect()]
    want = [(i, f"{p:016x}", c) for i, p, c in zip(range(len(texts)), prints, plain_components(prints, list(range(len(texts))), 2), strict=True)]
    lone = plain_fingerprint("something else altogether here")
    assert not any((lone ^ p).bit_count() <= 2 for p in prints)
    want += [want[9], (9, f"{lone:016x}", 9), (None, want[9][1], None), (None, "0" * 16, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_rows_and_odd_radius(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError, match="radius"):
        simhash.links_within(spark.createDataFrame([(1,)], "print long"), 15)


def test_query_on_given_tables(spark):
    """All rows of the given table, their fingerprints and components from plain code."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_fingerprint(r["text"]) for r in docs]
    roots = plain_components(prints, [r["doc_id"] for r in docs], 2)
    got = sorted(tuple(r) for r in simhash.op12_simhash_near_dedup(spark, sf).collect())
    assert got == [(r["doc_id"], f"{p:016x}", c) for r, p, c in zip(docs, prints, roots, strict=True)]
