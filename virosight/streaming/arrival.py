"""Streams: new samples appended once, tumbling counts, sessions, and a filter that keeps state by key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from virosight.operators.frequency import filter_step

#: Milliseconds of a year.
YEAR = 31_557_600_000


def _held(spark: SparkSession, folder: str, schema, epoch: int) -> DataFrame:
    """Rows of a folder that earlier batches wrote; none if it is not there yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema.add("batch", "long")).parquet(folder).where(F.col("batch") < epoch).drop("batch")


def append_new(stream: DataFrame, target: str, key: str, checkpoint: str, least: int = 10) -> StreamingQuery:
    """Appends arriving rows whose key is not in ``target``'s ``rows`` yet, once ``least`` of them have come together.

    Until then they wait: each batch writes all waiting rows to its own folder
    of ``pending``, and the newest such folder counts.  A batch reads what
    earlier batches wrote and overwrites its own folders, so a batch that is
    run again after a failure leaves the same rows.
    """

    def take(batch: DataFrame, epoch: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        schema = lambda: type(batch.schema)(list(batch.schema.fields))
        last = _newest(spark, f"{target}/pending", epoch)
        waiting = spark.createDataFrame([], batch.schema) if last is None else spark.read.schema(batch.schema).parquet(f"{target}/pending/batch={last}")
        rows = batch.unionByName(waiting.select(*columns)).dropDuplicates([key])
        rows = rows.join(_held(spark, f"{target}/rows", schema(), epoch).select(key), key, "left_anti").select(*columns).persist()
        enough = rows.limit(least).count() >= least
        empty = rows.limit(0)
        (rows if enough else empty).write.mode("overwrite").parquet(f"{target}/rows/batch={epoch}")
        (empty if enough else rows).write.mode("overwrite").parquet(f"{target}/pending/batch={epoch}")
        rows.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take).trigger(availableNow=True).start()


def _newest(spark: SparkSession, folder: str, epoch: int) -> int | None:
    """The latest batch before ``epoch`` that wrote to the folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    names = [f.getPath().getName() for f in files.listStatus(path)]
    return max((k for n in names if n.startswith("batch=") and (k := int(n.split("=")[1])) < epoch), default=None)


def tumbling(events: DataFrame, width: str, late: str, by: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums in windows of one width; rows later than ``late`` behind the newest are left out of a stream's result."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str, by: list[str], ts: str = "ts") -> DataFrame:
    """Runs of events of a key without a pause of ``gap``."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def filtered_frequency(events: DataFrame, key: str, seen: str, late: str, ts: str = "ts", rate: float = 0.05) -> DataFrame:
    """``key, n, freq``: a running frequency of a boolean by key, kept as state from batch to batch.

    Each micro-batch moves a key's frequency by ``rate`` for each of its rows
    towards what they show, oldest first.  State of a key without rows for the
    watermark's delay is dropped.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, freq = state.get if state.exists else (0, 0.5)
        for batch in batches:
            for value in batch.sort_values([ts, seen])[seen]:
                n, freq = n + 1, freq + rate * (float(value) - freq)
        state.update((n, freq))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 86_400_000)
        yield pd.DataFrame({key: [keys[0]], "n": [n], "freq": [freq]})

    rows = events.where(F.col(seen).isNotNull()).select(key, ts, seen).withWatermark(ts, late)
    kind = dict(events.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, freq double", "n long, freq double", "update", "EventTimeTimeout")


def particle_stream(
    events: DataFrame, key: str, seen: str, late: str, start: int, step: int, particles: int = 500, sigma: float = 5.0, every: int = 10, seed: int = 0, ts: str = "ts"
) -> DataFrame:
    """``key, at, freq``: the particle filter of ``frequency.particle_filter`` over a stream; particles are the state of their key.

    Steps are ``step`` milliseconds long from ``start`` (milliseconds since
    1970).  A step is filtered once the watermark (``late`` behind the newest
    row) has passed its end, by then all of its rows are there, so arrival in
    another order or in other batches changes nothing; rows of filtered steps
    are late and left out, as are null ones and those before ``start``.  State
    is the particles, their random generator and the counts of the open steps.
    A timer filters on where a key has no new rows.  A row is given out on
    every ``every``-th step.
    """
    kind = dict(events.dtypes)[key]
    dt = step / YEAR

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        if state.exists:
            k, x, held, waiting = state.get
            x, waiting = np.frombuffer(x, np.float64), {int(i): c for i, c in json.loads(waiting).items()}
            rng.bit_generator.state = json.loads(held)
        else:
            k, x, waiting = 0, np.full(particles, 0.5), {}
        if not state.hasTimedOut:
            for batch in batches:
                for i, own in batch.groupby("_k"):
                    if i >= k:
                        yes, n = waiting.get(int(i), (0, 0))
                        waiting[int(i)] = (yes + int(own[seen].sum()), n + len(own))
        now, rows = state.getCurrentWatermarkMs(), []
        while start + (k + 1) * step <= now:
            x = filter_step(x, rng, *waiting.pop(k, (0, 0)), dt, sigma)
            if k % every == 0:
                rows.append((keys[0], pd.Timestamp(start + k * step, unit="ms"), float(x.mean())))
            k += 1
        state.update((k, x.tobytes(), json.dumps(rng.bit_generator.state), json.dumps(waiting)))
        state.setTimeoutTimestamp(max(start + (k + 1) * step, now + 1))
        if rows:
            yield pd.DataFrame(rows, columns=[key, "at", "freq"])

    place = F.floor((F.unix_millis(ts) - start) / step).alias("_k")
    rows = events.withWatermark(ts, late).where(F.col(seen).isNotNull() & (F.unix_millis(ts) >= start)).select(key, ts, seen, place)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, at timestamp, freq double", "k long, x binary, rng string, waiting string", "append", "EventTimeTimeout")
