"""Counts at places against the long tables, and kernels cut in small pieces."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from virosight.functions.sequences import differs_only, sites
from virosight.operators import pileup
from virosight.operators import sites as long_sites

ALPHABET = "ACGT-é𐍈"


def rows_of(rng, n=60):
    seq = lambda: "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 5, 30, 200])))
    return [(i, seq() if i % 7 else None, rng.choice(["a", "b", None]), rng.choice([1.5, 2.0, None])) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows_of(random.Random(1)), "id long, seq string, g string, w double")


def counted(rows, by=False, weight=False):
    out = Counter()
    for _, seq, g, w in rows:
        for pos, state in enumerate(seq or "", 1):
            out[(g, pos, state) if by else (pos, state)] += (w or 0.0) if weight else 1
    return out


def test_counts(spark, table):
    rows = rows_of(random.Random(1))
    got = {(r["pos"], r["state"]): r["n"] for r in pileup.frequencies(pileup.pileup(table, "seq")).collect()}
    assert got == counted(rows)
    got = {(r["g"], r["pos"], r["state"]): r["n"] for r in pileup.frequencies(pileup.pileup(table, "seq", ["g"]), by=["g"]).collect()}
    assert got == counted(rows, by=True)
    got = {(r["pos"], r["state"]): r["n"] for r in pileup.frequencies(pileup.pileup(table, "seq", weight=F.col("w"))).collect()}
    assert got == pytest.approx(counted(rows, weight=True))
    assert pileup.pileup(table.limit(0), "seq").collect() == []


def test_summaries_equal_the_long_table(spark, table):
    piles = pileup.pileup(table, "seq")
    # Java's split takes a code point beyond the basic plane apart, so such states are left to the test above.
    plain = table.withColumn("seq", F.translate("seq", "𐍈", "é"))
    piles, freqs = pileup.pileup(plain, "seq"), long_sites.site_frequencies(sites(plain, "seq"))
    key = lambda df: {r["pos"]: r for r in df.collect()}
    a, b = key(pileup.entropy(piles)), key(long_sites.entropy(freqs))
    assert a.keys() == b.keys() and all(math.isclose(a[p]["entropy"], b[p]["entropy"], abs_tol=1e-9) and a[p]["states"] == b[p]["states"] for p in a)
    one = lambda df: {r["pos"]: r["state"] for r in df.collect()}
    assert one(pileup.consensus(piles, "TGCA")) == one(long_sites.consensus(freqs.where(F.col("state").isin(*"ACGT")), "TGCA"))
    assert key(pileup.variable_sites(piles, 0.4)).keys() == key(long_sites.variable_sites(freqs, 0.4)).keys()
    want = {r["g"]: r["distance"] for r in long_sites.population_distance(freqs, long_sites.site_frequencies(sites(plain, "seq", "g"), by=["g"]), ["g"]).collect()}
    # The long table joins on the group, so a null one gets no distance there.
    assert {r["g"]: r["distance"] for r in pileup.population_distance(plain, "seq", "g").collect() if r["g"]} == pytest.approx(want)


def test_differences_and_genotypes(spark, table):
    plain = table.withColumn("seq", F.translate("seq", "𐍈", "é")).withColumn("root", F.lit("ACGTACGTTTé"))
    want = sorted(tuple(r) for r in differs_only(plain, F.col("root"), "seq", "id").collect())
    assert want and sorted(tuple(r) for r in pileup.differences_from_root(plain, F.col("root"), "seq", "id").collect()) == want
    rows = rows_of(random.Random(1))
    got = sorted(r["id"] for r in table.where(pileup.has_states(F.col("seq"), [(1, "A"), (2, "C")])).collect())
    assert got == [i for i, s, _, _ in rows if s and s[:2] == "AC"]


def test_scores_of_places(spark, table, monkeypatch):
    monkeypatch.setattr(pileup, "BLOCK", 16)
    rng = random.Random(2)
    scores = {(p, s): rng.random() for p in range(1, 150) for s in ALPHABET if rng.random() < 0.5}
    given = spark.createDataFrame([(p, s, v) for (p, s), v in scores.items()], "pos int, state string, value double")
    rows = rows_of(random.Random(1))
    want = {i: sum(scores.get((p, s), 0.0) for p, s in enumerate(seq or "", 1)) for i, seq, _, _ in rows}
    assert {r["id"]: r["score"] for r in pileup.place_scores(table, "seq", "id", given).collect()} == pytest.approx(want)


@pytest.mark.parametrize(("block", "call", "held"), [(8, 10, 20), (4096, 1 << 22, 1 << 22)])
def test_kernels_in_small_pieces(monkeypatch, block, call, held):
    """Blocks, calls and flushes of any size give the same counts."""
    for name, value in (("BLOCK", block), ("CALL", call), ("HELD", held)):
        monkeypatch.setattr(pileup, name, value)
    rows = rows_of(random.Random(3))
    batches = [pa.RecordBatch.from_arrays([pa.array([r[1] for r in some], pa.string()), pa.array([r[2] for r in some], pa.string())], names=["seq", "g"]) for some in (rows[:20], rows[20:], [])]
    partial = [b for b in pileup._counter(False)(iter(batches)) if b.num_rows]
    whole = pa.Table.from_batches(partial).sort_by([("g", "ascending"), ("block", "ascending")]).combine_chunks().to_batches()
    out = Counter()
    for b in pileup._merger(1)(iter(whole)):
        for r in b.to_pylist():
            assert r["total"] == sum(r["counts"])
            out.update({(r["g"], r["pos"], s): n for s, n in zip(r["states"], r["counts"], strict=True)})
    assert out == counted(rows, by=True)
    assert np.array_equal(pileup.code_points(["aé", "", "𐍈"])[1], [2, 0, 1])
