"""The quality model learns from every trusted text, and its two forms of scoring judge alike."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from virosight.llm import quality


def numbered(n):
    rng = random.Random(5)
    return [(i, "en", f"{''.join(rng.choice('abcdefgh ') for _ in range(40))} {i}") for i in range(n)]


def test_every_trusted_text_is_learned(spark):
    docs = spark.createDataFrame(numbered(5_000), "doc_id long, lang string, text string")
    docs = docs.unionByName(docs.where("doc_id < 50").withColumn("doc_id", F.col("doc_id") + 10_000)).unionByName(docs.where("doc_id < 20"))
    docs = docs.unionByName(spark.createDataFrame([(20_000, "en", "long trusted text " * 3_000)], docs.schema))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    want = sorted({r["text"] for r in docs.where(~quality._is_held("text")).collect()})
    assert len(want) > 3_000
    got = sorted(r["text"] for r in quality.trusted_sample(docs, labels).collect())
    assert got == want


def test_runs_of_long_texts_are_counted_range_by_range(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (0, 1, 3, 20, 64, 65, 500, 7)] + [None]
    want = Counter()
    for t in texts:
        data = b"\n" * 4 + (t or "").encode()
        want.update(int.from_bytes(data[i : i + 5], "big") for i in range(len(data) - 4))
    for size, gathered in ((64, 1 << 20), (64, 50), (1 << 20, 10)):
        monkeypatch.setattr(quality, "COUNTED_BYTES", size)
        monkeypatch.setattr(quality, "GATHERED_RUNS", gathered)
        got = Counter()
        for b in quality._counted(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])):
            for run, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got[run] += n
        assert got == want


def test_large_tables_stay_sharded_and_judge_alike(spark, monkeypatch):
    docs = spark.createDataFrame(numbered(300) + [(1, "en", "again with an id"), (None, None, None), (900, "en", ""), (901, "en", "%&/$" * 200)], "doc_id long, lang string, text string")
    docs = docs.unionByName(docs.where("doc_id in (2, 901) or doc_id is null"))
    labels = spark.createDataFrame([(i, 1) for i in range(250)], "doc_id long, quality int")
    key = ["doc_id", "bits", "limit_bits", "rejected"]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or 0)
    near = sorted((tuple(r) for r in quality.judge(docs, labels).select(*key).collect()), key=order)
    kept = sorted(map(repr, quality.keep_good(docs, labels).collect()))
    monkeypatch.setattr(quality, "MODEL_ROWS", 0)
    far = sorted((tuple(r) for r in quality.judge(docs, labels).select(*key).collect()), key=order)
    assert len(near) == len(far) == docs.count()
    for a, b in zip(near, far, strict=True):
        assert a[0] == b[0] and a[3] == b[3] and np.allclose([a[1] or 0, a[2]], [b[1] or 0, b[2]], atol=1e-3), (a, b)
    assert sorted(map(repr, quality.keep_good(docs, labels).collect())) == kept
