"""Five stages that clean a corpus: quality, language, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on what the one before it
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from virosight.llm.decontaminate import drop_contaminated
from virosight.llm.language_id import keep_identified, learn_languages, training_rows
from virosight.llm.near_dups import drop_near_duplicates
from virosight.llm.pieces import token_digests
from virosight.llm.quality import keep_good
from virosight.llm.text import discard, scratch, written
from virosight.session import bounded_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    """Stages carry whole texts to Python, so they bound the bytes of a batch."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_bounded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the limit of their language."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_bounded
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified by a clear margin."""
    return keep_identified(docs, learn_languages(training_rows(docs)))


@_bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_duplicates(docs)


@_bounded
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_bounded
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    return token_digests(docs)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]

#: SQL expresses neither the trained models nor the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    What each but the last returns is written to the shared folder and deleted
    when the next is; what a stage needed besides goes with its end.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch():
            before, docs = docs, written(stage(spark, docs, sf_dir), keep=True)
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
