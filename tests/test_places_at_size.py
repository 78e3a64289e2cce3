"""Queries over places of texts on odd tables, against their SQL and small bounds."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from virosight.operators import pileup, sites
from virosight.plans.catalogue import ORACLES, QUERIES


def sql_rows(name, **tables):
    con = duckdb.connect()
    for t, path in tables.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
    return con.execute(ORACLES[name]).fetchall()


def written(df, folder, name):
    df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return f"{folder}/{name}.parquet"


def test_tolerance_of_texts_without_characters(spark, tmp_path):
    """Texts without a character have no row in the SQL, and a null id is a group like any other."""
    rows = [(1, "abba"), (2, ""), (3, None), (4, "ab"), (None, "aab"), (None, "b")]
    docs = spark.createDataFrame([(i, t, "en", "src1") for i, t in rows], "doc_id long, text string, lang string, source string")
    path = written(docs, tmp_path, "documents")
    got = {r["doc_id"]: r["tolerance"] for r in QUERIES["tolerance_score"](spark, str(tmp_path)).collect()}
    assert got.keys() == {1, 4, None} and got == dict(sql_rows("tolerance_score", documents=path))


def test_counts_of_a_block_are_added_up_as_they_come():
    """However many tasks counted a block, the task that merges it holds its different keys and not all that were sent."""
    keys, held = np.arange(20_000), []

    def batches(fields):
        for _ in range(300):
            held.append(pa.total_allocated_bytes())
            lists = [pa.array([x]) for x in (keys, np.ones(len(keys), np.int64))]
            yield pa.RecordBatch.from_arrays([*(pa.array([v], t) for _, v, t in fields), *lists], names=[*(n for n, _, _ in fields), "at", "n"])

    group, block = ("g", "a", pa.string()), ("block", 0, pa.int32())
    (out,) = list(pileup._distances(batches([group, block])))
    assert out.to_pylist() == [{"g": "a", "s": 1.0 * len(np.unique(keys >> pileup._BITS)) * np.sum(np.full(len(keys), 1 / len(keys)) ** 2), "places": 1}]
    (piles,) = list(pileup._merger(0)(batches([block])))
    assert piles.to_pylist()[0]["total"] == 300 * len(keys)
    # All parts at once are 96 MB.
    assert max(held) - min(held) < 20e6


def test_pieces_are_counted_in_small_calls(spark, monkeypatch):
    """Pieces, calls and deals of any size give the same distances."""
    rows = [(f"g{i % 3}" if i % 5 else None, "abcé𐍈"[i % 4 :] * (i % 9)) for i in range(60)] + [("g0", None)]
    df = spark.createDataFrame(rows, "g string, seq string")
    got = {tuple(r) for r in pileup.population_distance(df, "seq", "g").select("g", pileup.F.round("distance", 9)).collect()}
    for name, value in (("PIECE", 4), ("PIECES_CALL", 10), ("DEALS", 3), ("WAITING", 2)):
        monkeypatch.setattr(pileup, name, value)
    assert {tuple(r) for r in pileup.population_distance(df, "seq", "g").select("g", pileup.F.round("distance", 9)).collect()} == got
    assert {g for g, _ in got} == {"g0", "g1", "g2", None}


@pytest.mark.parametrize("profiles", [1 << 22, 100])
@pytest.mark.parametrize("name", ["closest_clade", "closest_clade_strict"])
def test_closest_clade_of_odd_texts(spark, tmp_path, monkeypatch, name, profiles):
    """Equal to the SQL with repeated ids, empty and null texts, ties and several blocks of references; no row for each difference is written."""
    monkeypatch.setattr(sites, "PROFILES", profiles)
    monkeypatch.setattr(sites, "saved", lambda *a, **k: pytest.fail("a table of differences is written"))
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ACGé𐍈") for _ in range(n))
    items = [(i + 1, text(rng.choice([0, 5, 20, 40]) if i else 30)) for i in range(12)]
    items += [(20, items[2][1]), (21, None), (4, text(10))]
    docs = [(i % 70, rng.choice([None, "", text(3), text(25), text(60), items[i % 12][1]])) for i in range(80)] + [(None, items[3][1]), (None, text(30))]
    paths = {
        "documents": written(spark.createDataFrame(docs, "doc_id long, text string"), tmp_path, "documents"),
        "benchmark": written(spark.createDataFrame(items, "item_id long, text string"), tmp_path, "benchmark"),
    }
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert len(got) > 20 and sorted(got, key=repr) == sorted(sql_rows(name, **paths), key=repr)
    spark.createDataFrame([], "item_id long, text string").write.mode("overwrite").parquet(paths["benchmark"])
    assert QUERIES[name](spark, str(tmp_path)).collect() == []
