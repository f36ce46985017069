"""Structured Streaming plumbing shared by the streaming operators.

Inputs are file sources (JSON); every stream has its own checkpoint location
under the shared checkpoint folder, so a restarted query resumes from its
offsets and committed sink state. Replays restart the query once per slice,
which exercises exactly that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlens.runtime import scratch_dir


class Replay:
    """A table cut into event-time slices that enter a file-stream folder one
    at a time. Each slice is written by every task that holds its rows."""

    def __init__(self, sliced: Callable[[int], DataFrame] | None, path: str, n_slices: int):
        self.sliced, self.path, self.n_slices = sliced, path, n_slices

    def write(self, i: int) -> None:
        self.sliced(i).write.mode("append").json(self.path)


def stage_slices(df: DataFrame, path: str, order_col: str, n_slices: int = 6) -> Replay:
    """Cut ``df`` into ``n_slices`` equal ranges of ``order_col`` and write the
    first; :func:`run_slices` writes the others between query runs. ``df`` is
    worked out once, into a table beside ``path`` that the slices are read from."""
    staged = f"{path}-staged"
    df.write.mode("overwrite").parquet(staged)
    df = df.sparkSession.read.schema(df.schema).parquet(staged)
    bounds = df.agg(F.min(order_col).alias("lo"), F.max(order_col).alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    if lo is None:
        df.limit(0).write.mode("overwrite").json(path)
        return Replay(None, path, 1)
    width = max(1, (hi - lo + n_slices) // n_slices)
    rp = Replay(lambda i: df.filter(F.col(order_col).between(lo + i * width, lo + (i + 1) * width - 1)), path, n_slices)
    rp.write(0)
    return rp


_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_slices(spark: SparkSession, replay: Replay | None, start) -> None:
    """Run ``start()`` (a query with ``availableNow``) once per slice, resuming
    from its checkpoint: every run consumes exactly the slice written before
    it as one micro-batch, in slice order, with watermark and state restored
    from the checkpoint. No-data batches are allowed only in the last run, so
    the batch sequence equals one continuous run fed one slice per batch."""
    if replay is None:
        start().awaitTermination()
        return
    old = spark.conf.get(_NO_DATA, "true")
    try:
        for i in range(replay.n_slices):
            if i > 0:
                replay.write(i)
            spark.conf.set(_NO_DATA, "true" if i == replay.n_slices - 1 else "false")
            start().awaitTermination()
    finally:
        spark.conf.set(_NO_DATA, old)


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str, mode: str = "append",
                   replay: Replay | None = None) -> None:
    """Run a stream over its replayed input into a parquet sink."""
    run_slices(stream.sparkSession, replay, lambda: (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
              .outputMode(mode).trigger(availableNow=True).start()))


def run_foreach_batch(stream: DataFrame, fn, checkpoint: str, replay: Replay | None = None,
                      mode: str = "append") -> None:
    run_slices(stream.sparkSession, replay, lambda: (
        stream.writeStream.outputMode(mode).foreachBatch(fn).option("checkpointLocation", checkpoint)
              .trigger(availableNow=True).start()))


def workdir(spark: SparkSession, name: str) -> dict[str, str]:
    base = scratch_dir(spark, name)
    return {"base": base, "input": f"{base}/input", "out": f"{base}/out", "ckpt": f"{base}/checkpoint"}
