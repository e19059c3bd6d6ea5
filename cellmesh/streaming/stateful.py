"""Stateful streams: cells that are sent when they reach a threshold, and exponential histograms."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.frames import join_null_safe
from ..operators.linear import Shape, addressed
from ..operators.windows import compacted
from ..sources.folders import scratch
from .closing import BLOCK, crossed, packed, spread

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Threshold(StatefulProcessor):
    """Sends a cell's mass when it reaches tau in size, and starts the cell anew.  Signed cells send at either sign.

    One state for a block of columns of a row; a batch's updates are run at once.
    """

    def __init__(self, tau: float, signed: bool):
        self.tau, self.signed = tau, signed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "col array<int>, v array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = dict(zip(*self.held.get(), strict=True)) if self.held.exists() else {}
        for cols, w in chain.from_iterable(map(spread, rows)):
            cols, d = crossed(held, cols, w, self.tau, self.signed)
            if len(cols):
                yield pd.DataFrame({"row": key[0], "col": cols, "d": d})
        left = {c: v for c, v in held.items() if v != 0}
        self.held.update(([int(c) for c in left], [float(v) for v in left.values()]))

    def close(self) -> None:
        pass


def thresholded(stream: DataFrame, key: str, tau: float, shape: Shape = Shape(), weight: str | None = None) -> DataFrame:
    """``(row, col, d)`` messages of a stream's cells.  Keyed by row and block of columns: at most ``rows * cols`` cells in all.

    Updates reach their states as runs (:func:`closing.packed`): of unit weights each task sends few rows, however many its items are.
    What a cell still holds stays in the state: the sum of its messages lags by less than ``tau``.  A stream of
    windows flushes what is held (:func:`closing.window_thresholds`).
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    cells = addressed(stream.where(F.col(key).isNotNull()).select(F.col(key), w.alias("_w")), key, shape)
    rows = cells.select("row", F.expr(f"col div {BLOCK}").cast("int").alias("block"), "col", (F.col("sign") * F.col("_w")).alias("w"))
    return packed(rows, ["row", "block"]).groupBy("row", "block").transformWithStateInPandas(Threshold(tau, shape.signed), "row int, col int, d double", "Append", "None")


class Sliding(StatefulProcessor):
    """The buckets of one series; after each batch that has events of it, its present buckets are sent, with the batch's number for the series."""

    def __init__(self, k: int, window: int):
        self.k, self.window = k, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("buckets", "at bigint, min array<bigint>, max array<bigint>, size array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        at, *old = self.state.get() if self.state.exists() else (-1, [], [], [])
        held = [list(x) for x in zip(*old, strict=True)]
        for batch in rows:  # of a batch of Arrow rows, equal times are one bucket before they are united
            times, counts = np.unique(batch["ts"].dropna().to_numpy(np.int64), return_counts=True)
            held = compacted([*held, *([int(t), int(t), 1] for t, n in zip(times, counts, strict=True) for _ in range(n))], self.k, self.window)
        self.state.update((at + 1, *([r[i] for r in held] for i in range(3))))
        yield pd.DataFrame([(key[0], at + 1, *r) for r in held], columns=["series", "at", "min_ts", "max_ts", "size"])

    def close(self) -> None:
        pass


def sliding_counts(stream: DataFrame, series: str, ts: str, k: int, window: int) -> DataFrame:
    """``(series, at, min_ts, max_ts, size)``: the buckets of each series after each batch with events of it, numbered by ``at``.

    Events may come late: buckets are united anew, newest first.  :func:`latest` keeps the last state of each series.
    """
    rows = stream.select(F.col(series).cast("string").alias("series"), F.col(ts).cast("bigint").alias("ts"))
    return rows.groupBy("series").transformWithStateInPandas(Sliding(k, window), "series string, at bigint, min_ts bigint, max_ts bigint, size bigint", "Update", "None")


def latest(sent: DataFrame) -> DataFrame:
    """Of what :func:`sliding_counts` has sent, each series' last buckets."""
    last = sent.groupBy("series").agg(F.max("at").alias("at"))
    return join_null_safe(sent, last, ["series", "at"]).drop("at")


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State of arbitrary operators needs the RocksDB store."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


@contextlib.contextmanager
def kept_progress(spark: SparkSession, batches: int = 100_000) -> Iterator[None]:
    """Reports of so many micro-batches are kept."""
    name = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(name)
    spark.conf.set(name, batches)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LateRows(RuntimeError):
    """A stream dropped rows that came behind its watermark."""


def drained(out: DataFrame, mode: str = "append", timeout: int = 600, whole: bool = False) -> DataFrame:
    """Run a stream over all that is available now, and return what it wrote, as a table.

    With ``whole`` it is an error if a watermark dropped rows: a folder's files are read by their times
    (:func:`~cellmesh.sources.tables.in_order`), and those of an early time behind a late one come too late.

    In other modes than append each micro-batch is written to a folder of its own, which a retried one replaces; with ``complete`` the last
    one is the result.  A stream without input gives no rows.
    """
    spark = out.sparkSession
    folder = scratch(spark, "stream")
    rows = f"{folder}/rows"
    writer = out.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    if mode == "append":
        writer = writer.format("parquet").option("path", rows)
    else:
        writer = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{rows}/batch={number}"))
    with rocks(spark), kept_progress(spark):
        run = writer.start()
        done = run.awaitTermination(timeout)
        if not done:
            run.stop()
            raise TimeoutError("the stream did not end in time")
        late = sum(s.numRowsDroppedByWatermark for p in run.recentProgress for s in p.stateOperators)
        if late and whole:
            raise LateRows(f"{late} rows came too late")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(rows)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], out.schema)
    if mode == "append":
        return spark.read.schema(out.schema).parquet(rows)
    found = spark.read.schema(StructType([*out.schema.fields, StructField("batch", LongType())])).parquet(rows)
    if mode == "complete":
        found = found.where(F.col("batch") == found.agg(F.max("batch")).first()[0])
    return found.drop("batch")
