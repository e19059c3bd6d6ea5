"""What thresholded delta shipping sends, in closed form for unit weights.

A cell that reaches the threshold is sent and zeroed.  Of n unit updates a cell sends ``n div t`` times, ``n - n mod t`` in all, and holds
``n mod t``: no state is needed to know it in batch.  Sent and held mass add up to the exact sketch.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import as_list
from .linear import Linear, Shape


def emissions(df: DataFrame, key: str, threshold: int, worker: str | None = None, shape: Shape = Shape(), by: str | Iterable[str] = ()) -> DataFrame:
    """``(*by, [worker,] row, col, n, messages, emitted, residual)`` of Count-Min cells under unit updates; ``messages`` with the final flush."""
    group = [*as_list(by), *([worker] if worker else [])]
    cells = Linear.build(df, key, by=group, shape=shape).cells.withColumn("n", F.col("v").cast("bigint")).drop("v")
    return _closed(cells, threshold)


def bucket_emissions(buckets: DataFrame, threshold: int) -> DataFrame:
    """The same for buckets ``(..., cnt)``."""
    return _closed(buckets.withColumnRenamed("cnt", "n"), threshold)


def _closed(cells: DataFrame, t: int) -> DataFrame:
    if t < 1:
        raise ValueError("the threshold is a positive whole number")
    rest = F.pmod("n", F.lit(t))
    sent = ((F.col("n") - rest) / t).cast("bigint")
    return cells.withColumns({"messages": sent + (rest > 0).cast("bigint"), "emitted": F.col("n") - rest, "residual": rest})


def fair_threshold(error: float, n: int, k: int, buckets: int) -> float:
    """The threshold that spreads an error of ``error * n`` over k senders with so many populated buckets."""
    return error * n / max(1, k * buckets)
