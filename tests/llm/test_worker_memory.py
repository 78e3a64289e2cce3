"""A Python worker holds one operator's model, batches one by one, and sends batches of a bounded size."""

import gc
import random
import weakref
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.compute as pc

from virosight.llm import decontaminate, near_dups, pieces, quality
from virosight.session import BATCH_BYTES


def test_a_worker_lets_go_of_the_piece_table_when_it_works_for_another_operator():
    with open(pieces.default_model(), "rb") as f:
        table = weakref.ref(pieces.piece_table(f.read()))
    assert table() is not None
    assert sum(b.num_rows for b in near_dups._fingerprints(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b c d e f"])], names=["id", "text"])]))) == 1
    gc.collect()
    assert table() is None


def test_one_benchmark_block_takes_batches_one_by_one():
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words[5:15])
    texts = [" ".join(words), "nothing of it", None, item]
    for items, most in (([[("i", item.encode())]], 1), ([[("i", item.encode())], [("k", b"nothing of it")]], len(texts))):
        blocks = [SimpleNamespace(value=decontaminate._packed(x)) for x in items]
        read = []

        def batches(read=read):
            for k, t in enumerate(texts):
                read.append(k)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t], pa.string())], names=["id", "text"])

        out = decontaminate._scanner(blocks, 10, False)(batches())
        first = next(out)
        assert len(read) <= most
        rows = [r for b in [first, *out] for r in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)]
        assert rows == [(0, ["i"]), (1, ["k"] if len(items) > 1 else []), (2, []), (3, ["i"])]


def test_counted_runs_leave_in_bounded_batches():
    rng = random.Random(1)
    text = "".join(chr(rng.randrange(33, 127)) for _ in range(400_000))
    out = list(quality._counted(iter([pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])])))
    assert sum(pc.sum(b.column(1)).as_py() for b in out) == len(text)
    assert max(b.nbytes for b in out) <= BATCH_BYTES
