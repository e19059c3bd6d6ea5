"""Sketches of event-time windows.  The same functions take batch and streaming tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frames import as_list
from ..operators.hll import address
from ..operators.linear import Shape, addressed


def watermarked(df: DataFrame, ts: str, late: str) -> DataFrame:
    """``df`` with ``ts`` as a timestamp and a watermark on it: rows later than ``late`` are dropped by streaming windows."""
    out = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, late) if df.isStreaming else out


def windowed_cells(df: DataFrame, ts: str, key: str, width: str, by: str | Iterable[str] = (), shape: Shape = Shape(), slide: str | None = None) -> DataFrame:
    """``(window_start, *by, row, col, v)``: a Count-Min frame of each window.  A closed window's frame starts from nothing."""
    by = as_list(by)
    at = addressed(df.where(F.col(key).isNotNull()), key, shape)
    cells = at.groupBy(F.window(ts, width, slide), *by, "row", "col").agg(F.sum(F.col("sign").cast("double")).alias("v"))
    return cells.select(F.col("window.start").alias("window_start"), *by, "row", "col", "v")


def windowed_registers(df: DataFrame, ts: str, key: str, width: str, by: str | Iterable[str] = ()) -> DataFrame:
    """``(window_start, *by, reg, rho)``: a HyperLogLog frame of each window."""
    by = as_list(by)
    reg, rho = address(F.col(key))
    rows = df.where(F.col(key).isNotNull()).select(ts, *by, reg.alias("reg"), rho.alias("rho"))
    return rows.groupBy(F.window(ts, width), *by, "reg").agg(F.max("rho").alias("rho")).select(F.col("window.start").alias("window_start"), *by, "reg", "rho")


def delta_rows(frames: DataFrame, partition_key: str, closed: bool = True) -> DataFrame:
    """Frames as delta messages ``(partition_key, window_start, is_close, row, col, d)`` against an empty base."""
    return frames.select(F.col(partition_key).cast("string").alias("partition_key"), "window_start", F.lit(closed).alias("is_close"), "row", "col", F.col("v").alias("d"))


def sessions(df: DataFrame, ts: str, gap: str, by: str | Iterable[str]) -> DataFrame:
    """``(*by, session_start, session_end, n)``: events of a group no further apart than ``gap``."""
    by = as_list(by)
    out = df.groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
