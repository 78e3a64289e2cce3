"""Hard negatives against plain code and SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from virosight.llm import hard_negatives as hn

SHAPE = "vec_id long, embedding array<float>, label int"


def plain(rows, anchors):
    """rows (id, vector, label); anchors: ids."""
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float)), lab) for i, v, lab in rows if i is not None and v and lab is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in sorted(anchors):
        own = [(lab, tuple(v)) for i, v, lab in good if i == a]
        if not own:
            continue
        label, v = min(own)
        scored = [(-int(np.dot(w, v)), i, lab) for i, w, lab in good if len(w) == len(v)]
        near = sorted((s, i) for s, i, lab in scored if lab == label and i != a)[:5]
        for p, i in near:
            far = sorted((s, j) for s, j, lab in scored if lab != label and 30 * -p <= 100 * -s <= 90 * -p)[:10]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(far)]
    return sorted(out)


def clustered(rng, n, d, spread=0.15):
    centres = rng.normal(size=(6, d))
    x = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, d))
    x *= rng.uniform(0.3, 1.5, n)[:, None] / np.sqrt((x * x).sum(1, keepdims=True))
    return x.astype(np.float32)


@pytest.mark.parametrize(("leaf", "fan", "part"), [(4, 3, 60), (64, 32, 4096)])
def test_against_plain_code(spark, monkeypatch, leaf, fan, part):
    monkeypatch.setattr(hn, "LEAF", leaf)
    monkeypatch.setattr(hn, "FAN", fan)
    monkeypatch.setattr(hn, "PART_ROWS", part)
    rng = np.random.default_rng(part)
    x = clustered(rng, 500, 8)
    rows = [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(x)]
    # A third of the rows are one vector; ties; few rows of a label; odd rows; another length.
    rows += [(500 + i, rows[3][1], int(i % 3)) for i in range(250)]
    rows += [(800, rows[5][1], 9), (810, [0.0] * 8, 1), (820, [1.0, 2.0, 3.0], 1), (821, [1.0, 2.0, 2.5], 1), (822, [0.9, 1.0, 1.0], 2), (823, [0.1, 0.5, 1.0], 3)]
    rows += [(900, None, 1), (901, [], 1), (902, [None] * 8, 1), (903, [float("nan")] * 8, 1), (904, [float("inf")] + [0.0] * 7, 2), (910, rows[7][1], None), (None, rows[8][1], 1), rows[20], rows[21]]
    anchors = {i for i, _, _ in rows if i is not None and i % 10 == 0}
    table = spark.createDataFrame(rows, SHAPE).repartition(5).withColumns({"d": F.lit("clash"), "cell": F.lit(1), "v": F.lit(2), "id": F.lit(3)})
    got = hn.hard_negatives(table, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(rows, anchors)
    assert len(want) > 500
    assert sorted(tuple(r) for r in got.collect()) == want


def test_tree_covers_and_skips():
    """Radii cover every row, and on clustered vectors most leaves are skipped."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * clustered(rng, 2000, 16, 0.05).astype(float))
    tree = hn.Tree(np.arange(2000), np.zeros(2000, np.int64), x)
    assert sorted(tree.ids.tolist()) == list(range(2000)) and sum(b - a for *_, a, b in tree.leaves) == 2000
    queries = x[:50]
    scores = queries @ tree.vectors.T
    low, high = np.full(50, 20_000.0), np.full(50, 40_000.0)
    bounds = tree.bounds(queries, low, high)
    for k, (_, _, a, b) in enumerate(tree.leaves):
        held = np.where((scores[:, a:b] >= 20_000) & (scores[:, a:b] <= 40_000), scores[:, a:b], -np.inf).max(1)
        assert (bounds[:, k] >= held).all()
    assert np.isinf(bounds).mean() > 0.5


def test_large_numbers_stay_exact():
    x = np.array([[2.0**26, 1.0], [2.0**26, 3.0], [-(2.0**26), 5.0]])
    tree = hn.Tree(np.arange(3), np.zeros(3, np.int64), x)
    got = tree.search(x[:1], lambda q, part: np.ones((len(q), part.stop - part.start), bool), np.array([hn._NEVER + 1]), np.array([hn._ALWAYS]), 2)
    assert got[2].tolist() == [2**52 + 3, 2**52 + 1]


def test_nothing_to_do(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SHAPE), F.lit(True)).collect() == []
    rows = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], None)], SHAPE)
    assert hn.hard_negatives(rows, F.lit(True)).collect() == []
    assert hn.hard_negatives(rows, F.lit(None).cast("boolean")).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    cursor = con.execute(hn.ORACLE)
    columns = [c[0] for c in cursor.description]
    got = hn.op11_hard_negatives(spark, f"/root/testdata/{sf}").select(*columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(cursor.fetchall())
