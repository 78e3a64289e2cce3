"""The pipeline's stages bound the batches that carry texts to Python."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from virosight.session import BATCH_BYTES


def test_stages_bound_the_bytes_of_a_batch(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    for _, stage in corpus_pipeline.STAGES[1:]:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
        stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        wide = spark.range(0, 4_000, 1, 1).select(F.repeat(F.lit("x"), 4_000).alias("text"))
        assert wide.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 2 * BATCH_BYTES
