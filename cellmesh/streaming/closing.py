"""Windows of a stream that are sent piece by piece while they are open, and closed by the watermark.

Each window of a partition starts from an empty base.  While it is open, cells are sent as they change; an event-time timer at the
window's end sends the rest, tells that the window is closed, and drops its state.  What a window has sent adds up to its exact cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.crossing import Blocks
from ..operators.linear import Shape, addressed

#: Columns of one row that share a state: a hot partition is spread over its blocks, and a cold one has few.
BLOCK = 256
#: The row of a block that counts a window's items; it closes the window.
ITEMS = -1
KEYS = ["partition_key", "window_ms", "row", "block"]
MESSAGE = "partition_key string, window_ms bigint, seq bigint, is_close boolean, row int, col int, d double"


def summed(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums of each Arrow batch: a combiner before the shuffle, which keeps a stream free of state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.groupby(keys, dropna=False, sort=False, as_index=False)[value].sum()[[*keys, value]]

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    return rows.select(*keys, value).mapInPandas(run, f"{kinds}, {value} double")


#: Updates that a task packs at a time, runs of a packed row, and updates that are spread at a time.
PACKED, RUNS, SPREAD = 1 << 18, 128, 1 << 16


def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Updates ``(*keys, col, w)`` as rows ``(*keys, cols, w, n)`` of runs: n updates of a column, one after the other, that add the same.

    A combiner before the shuffle where order matters: of a task's updates each column's stay in order, and those of unit weight are one run.
    :func:`spread` reads the rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some, n = [], 0
        for batch in batches:
            some.append(batch)
            n += len(batch)
            if n >= PACKED:
                yield _runs(pd.concat(some), keys)
                some, n = [], 0
        if n:
            yield _runs(pd.concat(some), keys)

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keys)
    return rows.select(*keys, "col", "w").mapInPandas(run, f"{kinds}cols array<int>, w array<double>, n array<int>")


def _runs(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    group = rows.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
    order = np.lexsort((rows["col"].to_numpy(), group))
    group, col, w = group[order], rows["col"].to_numpy()[order], rows["w"].to_numpy(np.float64)[order]
    start = np.flatnonzero(np.concatenate([[True], (np.diff(group) != 0) | (np.diff(col) != 0) | (w[1:] != w[:-1])]))
    first = np.flatnonzero(np.diff(group[start], prepend=-1))
    place = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
    cut = np.flatnonzero(place % RUNS == 0)
    out = rows.iloc[order[start[cut]]][keys].reset_index(drop=True)
    each = {"cols": col[start], "w": w[start], "n": np.diff(np.append(start, len(col)))}
    return out.assign(**{c: pd.Series(np.split(x, cut[1:]), dtype=object) for c, x in each.items()})


def spread(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(cols, w)`` of the updates of packed rows, at most ``SPREAD`` at a time."""
    cols, w, n = (np.concatenate(batch[c].to_list()) for c in ("cols", "w", "n"))
    ends = np.cumsum(n, dtype=np.int64)
    for low in range(0, int(ends[-1]), SPREAD):
        at = np.searchsorted(ends, np.arange(low, min(low + SPREAD, int(ends[-1]))), "right")
        yield cols[at].astype(np.int64), w[at].astype(np.float64)


class Windowed(StatefulProcessor):
    """A state that lives as long as its window: a timer at the window's end, nothing for items that come later.

    Keys hold the window's start and ``width`` is its length, in milliseconds.
    """

    def __init__(self, width: int):
        self.width = width

    def end(self, key: tuple) -> int:
        return key[1] + self.width

    def open(self, key: tuple, timer_values) -> bool:
        """Whether the window is open; its timer is set."""
        if timer_values.getCurrentWatermarkInMs() >= self.end(key):
            return False
        if not self.state.exists():
            self.handle.registerTimer(self.end(key))
        return True

    def close(self) -> None:
        pass


class Deltas(Windowed):
    """Sends the cells of a block that have changed by ``threshold`` or more since they were sent last."""

    def __init__(self, width: int, threshold: float):
        super().__init__(width)
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "seq bigint, col array<int>, v array<double>")

    def _held(self) -> tuple[int, np.ndarray]:
        """The number of messages so far, and what is not sent of each column of the block."""
        held = np.zeros(BLOCK)
        if not self.state.exists():
            return 0, held
        seq, cols, values = self.state.get()
        held[np.asarray(cols, np.int64)] = values
        return seq, held

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        if not self.open(key, timer_values):
            return
        seq, held = self._held()
        for batch in rows:
            np.add.at(held, batch["col"].to_numpy(np.int64) % BLOCK, batch["w"].to_numpy(np.float64))
        ready = (held != 0) & (np.abs(held) >= self.threshold) & (key[2] != ITEMS)
        rest = np.flatnonzero((held != 0) & ~ready)
        self.state.update((seq + int(ready.any()), rest.tolist(), held[rest].tolist()))
        if ready.any():
            yield self._message(key, seq, np.flatnonzero(ready), held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, held = self._held()
        self.state.clear()
        if held.any():
            yield self._message(key, seq, np.flatnonzero(held), held)

    @staticmethod
    def _message(key: tuple, seq: int, at: np.ndarray, held: np.ndarray) -> pd.DataFrame:
        close, n = key[2] == ITEMS, len(at)
        row, col = ([None] * n, [None] * n) if close else ([key[2]] * n, at + key[3] * BLOCK)
        out = {"partition_key": [key[0]] * n, "window_ms": [key[1]] * n, "seq": [seq] * n, "is_close": [close] * n, "row": pd.array(row, "Int32"), "col": pd.array(col, "Int32"), "d": held[at]}
        return pd.DataFrame(out)


def window_ms(stream: DataFrame, width: str) -> int:
    """The length of a window in milliseconds."""
    seconds = stream.sparkSession.sql(f"SELECT unix_micros(timestamp '1970-01-01 00:00:00' + interval {width}) AS n").first()["n"]
    return seconds // 1000


def in_windows(stream: DataFrame, ts: str, key: str, width: str, partition: str | Column | None, shape: Shape, weight: str | None) -> DataFrame:
    """``KEYS`` with ``col`` and ``w``: each item's cells and their blocks."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    part = F.lit("all") if partition is None else (F.col(partition) if isinstance(partition, str) else partition).cast("string")
    items = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    named = items.select(part.alias("partition_key"), F.unix_millis(F.window(ts, width)["start"]).alias("window_ms"), F.col(key).alias("_key"), w.alias("_w"))
    at = addressed(named, "_key", shape)
    return at.select("partition_key", "window_ms", "row", F.expr(f"col div {BLOCK}").cast("int").alias("block"), "col", (F.col("sign") * F.col("_w")).alias("w"))


def window_deltas(stream: DataFrame, ts: str, key: str, width: str, partition: str | Column | None = None, shape: Shape = Shape(), threshold: float = 0.0, weight: str | None = None) -> DataFrame:
    """``(partition_key, window_start, seq, is_close, row, col, d)`` messages of a stream with a watermark on ``ts``.

    After each micro-batch a window's changed cells are sent, those that changed by ``threshold`` or more; ``seq`` counts a block's
    messages from 0.  At the window's end come the cells that are left, and one row with ``is_close`` whose ``d`` is the number of items.
    Items without key or time count nowhere; items of a closed window are late and dropped.  A null partition is one of its own.
    """
    cells = in_windows(stream, ts, key, width, partition, shape, weight)
    own = F.struct("row", "block", "col", "w")
    item = F.struct(F.lit(ITEMS).alias("row"), F.lit(0).alias("block"), F.lit(0).alias("col"), F.lit(1.0).alias("w"))
    # Row 0 of each item stands for it in the count of items.
    every = cells.select("partition_key", "window_ms", F.explode(F.when(F.col("row") == 0, F.array(own, item)).otherwise(F.array(own))).alias("e"))
    rows = summed(every.select("partition_key", "window_ms", "e.*"), [*KEYS, "col"], "w")
    return timed(rows.groupBy(*KEYS).transformWithStateInPandas(Deltas(window_ms(stream, width), threshold), MESSAGE, "Append", "EventTime"))


def timed(sent: DataFrame) -> DataFrame:
    """``window_start`` in the place of ``window_ms``."""
    return sent.select(*(F.timestamp_millis(c).alias("window_start") if c == "window_ms" else c for c in sent.columns))


def replayed(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a receiver holds: ``(partition_key, window_start, row, col, v)`` and ``(partition_key, window_start, items)`` of windows that are closed."""
    at = ["partition_key", "window_start"]
    cells = messages.where("not is_close").groupBy(*at, "row", "col").agg(F.sum("d").alias("v")).where("v <> 0")
    return cells, messages.where("is_close").groupBy(*at).agg(F.sum("d").cast("bigint").alias("items"))


class Thresholds(Windowed):
    """Sends a cell's mass when it reaches tau, item by item, and what a window's cells still hold at its end."""

    def __init__(self, width: int, tau: float, signed: bool):
        super().__init__(width)
        self.tau, self.signed = tau, signed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "col array<int>, v array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.open(key, timer_values):
            return
        held = dict(zip(*self.state.get(), strict=True)) if self.state.exists() else {}
        for cols, w in chain.from_iterable(map(spread, rows)):
            cols, d = crossed(held, cols, w, self.tau, self.signed)
            if len(cols):
                yield self._message(key, cols, d, False)
        left = {c: v for c, v in held.items() if v != 0}
        self.state.update(([int(c) for c in left], [float(v) for v in left.values()]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        cols, values = self.state.get() if self.state.exists() else ([], [])
        self.state.clear()
        if len(cols):
            yield self._message(key, list(cols), list(values), True)

    @staticmethod
    def _message(key: tuple, cols, d, flush: bool) -> pd.DataFrame:
        n = len(cols)
        return pd.DataFrame({"partition_key": [key[0]] * n, "window_ms": [key[1]] * n, "row": [key[2]] * n, "col": cols, "d": d, "flush": [flush] * n})


def crossed(held: dict[int, float], cols: np.ndarray, w: np.ndarray, tau: float, signed: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(cols, sent)`` of cells that updates make cross; ``held`` is left with what cells hold after them."""
    order = np.argsort(cols, kind="stable")
    names, start = np.unique(cols[order], return_index=True)
    blocks = Blocks(w[order], np.full(len(cols), float(tau)), np.append(start, len(cols)), signed)
    places, sent, left = blocks.run(np.array([held.get(c, 0.0) for c in names.tolist()], float))
    held.update(zip(names.tolist(), left.tolist(), strict=True))
    return cols[order][places], sent


def window_thresholds(stream: DataFrame, ts: str, key: str, width: str, tau: float, partition: str | Column | None = None, shape: Shape = Shape(), weight: str | None = None) -> DataFrame:
    """``(partition_key, window_start, row, col, d, flush)``: a window's cells go when they reach ``tau`` (at either sign, if signed), the rest at its end.

    Items without key or time count nowhere; items of a closed window are late and dropped.
    """
    rows = packed(in_windows(stream, ts, key, width, partition, shape, weight), KEYS)
    kinds = "partition_key string, window_ms bigint, row int, col int, d double, flush boolean"
    return timed(rows.groupBy(*KEYS).transformWithStateInPandas(Thresholds(window_ms(stream, width), tau, shape.signed), kinds, "Append", "EventTime"))
