"""Session builder with the settings the library expects, and tables written to the cluster's shared folder."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 2 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Time zone for reproducible dates, adaptive re-planning with skew handling, room for deep trees, and Arrow batches of a bounded size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "10000",
    _BATCHES: str(BATCH_BYTES),
}


def builder(app: str = "virosight") -> SparkSession.Builder:
    return SparkSession.builder.appName(app).config(map=SETTINGS)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches in a session that was made elsewhere.

    Without it a batch holds 10,000 rows whatever their texts, a whole
    partition of documents as a rule, and both the JVM (beside its heap) and the
    Python worker hold it at once.
    """
    spark.conf.set(_BATCHES, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Where that setting is missing, a session on one machine (as in tests)
    uses a folder in its warehouse, and a cluster gets an error: its
    machines would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local"):
            base = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_shared")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_scratch = threading.local()


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``saved`` writes within are deleted at the end, all but those written with ``keep``.

    Kept tables of an inner block belong to the block around it.
    """
    outer, _scratch.tables = getattr(_scratch, "tables", None), []
    try:
        yield
    finally:
        own, _scratch.tables = _scratch.tables, outer
        for spark, path, keep in own:
            if not keep:
                _deleted(spark, path)
            elif outer is not None:
                outer.append((spark, path, False))


def saved(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` as written to the cluster's shared checkpoint folder and read back.

    This cuts the lineage: a lost executor costs no earlier work, and every
    reader sees the same rows.  Within ``scratch`` the table goes at its end
    unless ``keep`` is set.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if getattr(_scratch, "tables", None) is not None:
        _scratch.tables.append((spark, path, keep))
    return out


def _deleted(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def dropped(df: DataFrame) -> None:
    """Delete a table of ``saved`` that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = name.rsplit("/", 1)[0]
        if path.endswith("/table"):
            _deleted(spark, path)


#: Rows (or entries of arrays in them) that ``few`` lets go to every executor.
FEW = 1 << 20


def few(df: DataFrame, weight: Column | None = None) -> DataFrame | None:
    """``df`` to be broadcast if it has at most ``FEW`` rows, or entries by ``weight``; else None.  The size is counted first."""
    size = df.select((F.lit(1) if weight is None else weight).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    return F.broadcast(df) if size <= FEW else None
