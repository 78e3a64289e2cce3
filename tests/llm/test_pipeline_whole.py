"""The pipeline's quality stage learns from every trusted text."""

from pyspark.sql import functions as F

import corpus_pipeline
from virosight.llm import quality


def test_quality_stage_learns_from_every_trusted_text(spark, tmp_path, monkeypatch):
    docs = spark.range(4_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("trusted text "), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    learned = []

    class Seen(Exception):
        pass

    def seen(trusted, text_col="text"):
        learned.append(trusted.count())
        raise Seen

    for name in ("train", "train_tables"):
        monkeypatch.setattr(quality, name, seen)
    try:
        corpus_pipeline.quality(spark, docs, str(tmp_path))
    except Seen:
        pass
    assert learned == [docs.where(~quality._is_held("text")).count()] and learned[0] > 3_000
