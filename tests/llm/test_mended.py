"""Clashing columns, many labels, benchmark blocks, vector lengths, and what is left in the shared folder."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from virosight.llm import ann, decontaminate, hard_negatives, language_id, near_dups, quality, simhash, spelling, toxicity
from virosight.llm.text import scratch, written

SF = "/root/testdata/sf0.001"
CLASHES = ["_bits", "_held", "_limit", "_own", "_bytes", "_rest", "_rejected", "_row", "_text", "_id", "id", "n", "key", "limit", "none"]


def tables(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_two_thousand_languages(spark):
    rows = [(f"l{i}", f"wort{i} satz{i} ende{i}") for i in range(2000)]
    model = language_id.learn_languages(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model) == 2000 and model["l7"].split() == b"wort7 satz7 ende7".split()
    with pytest.raises(ValueError, match="more than"):
        language_id.learn_languages(spark.createDataFrame([*rows, ("one", "more")], "lang string, text string"))


def test_quality_stage_with_clashing_columns(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    want = sorted(r["doc_id"] for r in quality.keep_good(docs, labels).select("doc_id").collect())
    more = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    kept = quality.keep_good(more, labels)
    assert kept.columns == more.columns and 0 < len(want) < docs.count()
    got = kept.collect()
    assert sorted(r["doc_id"] for r in got) == want
    assert all(r[c] == f"own {c}" for r in got for c in CLASHES)
    assert quality.keep_good(docs.select("doc_id", "lang", "text"), labels).count() == len(want)


@pytest.mark.parametrize("stage", ["language", "near_duplicates", "decontaminate", "tokens"])
def test_other_stages_with_clashing_columns(spark, stage):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    want = sorted(r["doc_id"] for r in run(spark, docs, SF).select("doc_id").collect())
    more = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    assert sorted(r["doc_id"] for r in run(spark, more, SF).select("doc_id").collect()) == want


def test_benchmark_blocks_share_one_worker(spark, monkeypatch):
    """Whatever the number of blocks the plan has one Python node, spools are cut, and the rows are the same."""
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(tuple(r) for r in decontaminate.contamination(docs, bench, with_offsets=True).collect())
    assert any(r[2] for r in want)
    kept = sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "SPOOL_BYTES", 20_000)
    many = decontaminate.contamination(docs, bench, with_offsets=True, block_words=12)
    assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(tuple(r) for r in many.collect()) == want
    without = decontaminate.drop_contaminated(docs, bench, block_words=12)
    assert without._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(r["doc_id"] for r in without.collect()) == kept


def test_toxic_texts_are_found(spark):
    """Held-out recall and false alarms on the given tables (a tenth of the toxic labels there stand beside clean texts)."""
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and toxic is not null").select("toxic", "predicted").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == k] for k in (1, 0))
    assert np.mean(toxic) > 0.7 and np.mean(clean) < 0.02


def test_windows_of_scripts_without_spaces():
    assert toxicity._windows(b"ab " + b"x" * 30) == {b" ab ", b"x" * 9} and toxicity._windows(b"") == set()


def test_neighbours_of_many_lengths(spark, monkeypatch):
    """Lengths without a sample are searched in full."""
    monkeypatch.setattr(ann, "LENGTHS", 2)
    monkeypatch.setattr(hard_negatives, "LENGTHS", 2)
    rng = np.random.default_rng(3)
    rows = [(d * 100 + i, rng.normal(size=d).tolist(), i % 2) for d in range(1, 40) for i in range(4 + d % 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {}
    for r in ann.nearest(table, F.lit(True), 2).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for i, v, _ in rows:
        others = [(-(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), j) for j, w, _ in rows if len(w) == len(v) and i != j]
        # One component has only two directions, whose cosines tie but for rounding.
        assert len(v) == 1 or got[i] == [j for _, j in sorted(others)[:2]]
    negatives = hard_negatives.hard_negatives(table, F.lit(True))
    assert {len(str(r["anchor_id"])) for r in negatives.collect()} == {3, 4}


def test_operators_leave_only_their_result(spark):
    docs, labels, vectors = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "embeddings"))
    for run in (
        lambda: near_dups.near_duplicates(docs), lambda: simhash.simhash_groups(docs), lambda: spelling.variants(docs), lambda: quality.judge(docs, labels),
        lambda: ann.nearest(vectors, F.col("vec_id") % 50 == 0), lambda: hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0),
    ):
        before = tables(spark)
        out = run()
        assert len(tables(spark) - before) == 1
        assert out.count() > 0


def test_scratch(spark):
    before = tables(spark)
    with scratch():
        written(spark.range(3))
        with scratch():
            inner = written(spark.range(4), keep=True)
            written(spark.range(5))
        assert inner.count() == 4 and len(tables(spark) - before) == 2
        out = written(inner, keep=True)
    assert out.count() == 4 and len(tables(spark) - before) == 1
    with pytest.raises(RuntimeError), scratch():
        written(spark.range(3), keep=False)
        raise RuntimeError
    assert len(tables(spark) - before) == 1


def test_one_large_class_of_copies(spark):
    """Copies of one text, and texts without words, get their component through salted look-ups."""
    rng = random.Random(1)
    words = " ".join(str(rng.random()) for _ in range(50))
    rows = [(i, words if i % 2 else None) for i in range(100, 400)] + [(None, words), (None, None)]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 101 if i % 2 else i, i == 101 or not i % 2) for i in range(100, 400)} | {(None, None, True)}
