"""Sketches in the state of a stream: sliding windows whose buckets hold sketches, heavy hitters, and registers with a feed of changes.

A combiner sums each Arrow batch before the shuffle where order does not matter, so a hot key reaches its state as few rows.  States are
bounded by parameters.  What is sent carries ``at``, the number of the state's batch; :func:`last` keeps what holds now.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import hll
from ..operators.ddsketch import Mapping
from ..operators.frames import as_list, join_null_safe, top_k
from ..operators.heavy import Tracked
from ..operators.linear import Shape, addressed
from ..operators.windows import per_size


def last(sent: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Of what states have sent, the rows of each state's last batch."""
    keys = as_list(keys)
    return join_null_safe(sent, sent.groupBy(*keys).agg(F.max("at").alias("at")), [*keys, "at"]).drop("at")


# --- sliding windows ---


def cuts(sizes: np.ndarray, c: int) -> np.ndarray:
    """Where buckets start, of rows from the newest on: each takes as many as the invariant lets it, ``newer // c + 1`` events, or one row."""
    total, out, at = np.concatenate([[0], np.cumsum(sizes)]), [], 0
    while at < len(sizes):
        out.append(at)
        at = max(at + 1, int(np.searchsorted(total, total[at] + total[at] // c + 1, "right")) - 1)
    return np.array(out, np.int64)


class Sliding(StatefulProcessor):
    """The buckets of one series, newest first, each with a payload of places and values that add up or whose largest counts."""

    def __init__(self, k: int, window: int, largest: bool):
        self.c, self.window, self.merge = per_size(k), window, np.maximum if largest else np.add

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buckets = handle.getListState("buckets", "low bigint, high bigint, size bigint, place array<int>, v array<double>")
        self.batches = handle.getValueState("batches", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = list(self.buckets.get()) if self.buckets.exists() else []
        for batch in rows:
            held = self._united(held, batch["ts"].to_numpy(np.int64), batch["place"].to_numpy(np.int64), batch["v"].to_numpy(np.float64))
        at = self.batches.get()[0] + 1 if self.batches.exists() else 0
        self.batches.update((at,))
        self.buckets.put(held)
        n = len(held)
        table = {"series": [key[0]] * n, "part": [key[1]] * n, "at": [at] * n} | {c: [b[i] for b in held] for i, c in enumerate(("min_ts", "max_ts", "size", "place", "v"))}
        yield pd.DataFrame(table)

    def _united(self, held: list[tuple], ts: np.ndarray, place: np.ndarray, v: np.ndarray) -> list[tuple]:
        """Buckets of those before and of new events, each a bucket of its own at first; those that ended before the window are gone."""
        n = len(held)
        low, high, size = (np.concatenate([np.array([b[i] for b in held], np.int64), x]) for i, x in enumerate((ts, ts, np.ones(len(ts), np.int64))))
        order = np.lexsort((-low, -high))
        order = order[high[order] >= high.max() - self.window]
        start = cuts(size[order], self.c)
        of = np.full(len(low), -1, np.int64)
        of[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        # Payloads by bucket and place.
        lengths = np.array([len(b[3]) for b in held], np.int64)
        bucket = np.concatenate([np.repeat(of[:n], lengths), of[n:]])
        places = np.concatenate([*(np.asarray(b[3], np.int64) for b in held), place])
        values = np.concatenate([*(np.asarray(b[4], np.float64) for b in held), v])
        sort = np.lexsort((places, bucket))
        sort = sort[bucket[sort] >= 0]
        bucket, places, values = bucket[sort], places[sort], values[sort]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(bucket) != 0) | (np.diff(places) != 0)]))
        values = self.merge.reduceat(values, first)
        ends = np.searchsorted(bucket[first], np.arange(len(start) + 1))
        lows, highs, sizes = np.minimum.reduceat(low[order], start), np.maximum.reduceat(high[order], start), np.add.reduceat(size[order], start)
        out = []
        for b, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            out.append((int(lows[b]), int(highs[b]), int(sizes[b]), places[first[i:j]].tolist(), values[i:j].tolist()))
        return out

    def close(self) -> None:
        pass


BUCKETS = "series string, part int, at bigint, min_ts bigint, max_ts bigint, size bigint, place array<int>, v array<double>"


def _sliding(rows: DataFrame, k: int, window: int, largest: bool) -> DataFrame:
    """``BUCKETS`` of rows ``series, part, ts, place, v``: the buckets of each series and part after each batch with events of it."""
    rows = rows.select(F.col("series").cast("string"), F.col("part").cast("int").alias("part"), F.col("ts").cast("bigint").alias("ts"), F.col("place").cast("int").alias("place"), F.col("v").cast("double").alias("v"))
    return rows.where(F.col("ts").isNotNull()).groupBy("series", "part").transformWithStateInPandas(Sliding(k, window, largest), BUCKETS, "Update", "None")


def sliding_cells(stream: DataFrame, series: str, ts: str, key: str, k: int, window: int, shape: Shape = Shape()) -> DataFrame:
    """``BUCKETS`` of a Count-Min or Count-Sketch in each bucket: a part is a row of the sketch, a place a column.

    Every event is in each row once, so all rows of a series have the same buckets.  Events may come late; keys must not be null.
    """
    rows = stream.where(F.col(key).isNotNull()).select(F.col(series).alias("series"), F.col(ts).alias("ts"), F.col(key).alias("_key"))
    return _sliding(addressed(rows, "_key", shape).select("series", F.col("row").alias("part"), "ts", F.col("col").alias("place"), F.col("sign").alias("v")), k, window, False)


def sliding_registers(stream: DataFrame, series: str, ts: str, key: str, k: int, window: int) -> DataFrame:
    """``BUCKETS`` of HyperLogLog registers: a place is a register, a value its largest rank."""
    reg, rho = hll.address(F.col(key))
    rows = stream.where(F.col(key).isNotNull()).select(F.col(series).alias("series"), F.lit(0).alias("part"), F.col(ts).alias("ts"), reg.alias("place"), rho.alias("v"))
    return _sliding(rows, k, window, True)


def sliding_quantiles(stream: DataFrame, series: str, ts: str, value: str, k: int, window: int, mapping: Mapping = Mapping()) -> DataFrame:
    """``BUCKETS`` of DDSketch buckets; values that cannot be indexed are left out."""
    v = F.col(value).cast("double")
    rows = stream.where(mapping.indexable(v)).select(F.col(series).alias("series"), F.lit(0).alias("part"), F.col(ts).alias("ts"), mapping.bucket(v).alias("place"), F.lit(1.0).alias("v"))
    return _sliding(rows, k, window, False)


def entries(buckets: DataFrame, names: tuple[str, str, str] = ("row", "col", "v"), largest: bool = False) -> DataFrame:
    """``(series, part, place, v)`` by other names: the payloads of buckets merged into one sketch a series."""
    rows = buckets.select("series", "part", F.explode(F.arrays_zip("place", "v")).alias("e")).select("series", F.col("part").alias(names[0]), F.col("e.place").alias(names[1]), F.col("e.v").alias("v"))
    return rows.groupBy("series", *names[:2]).agg((F.max if largest else F.sum)("v").alias(names[2]))


# --- heavy hitters ---

#: States of a group: keys are dealt to them by hash.
SALTS = 8


class Hitters(StatefulProcessor):
    """At most k keys of one group and salt; after each batch with keys of it, all of them are sent."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tracked", "at bigint, key array<string>, cnt array<double>, err array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        at, *old = self.state.get() if self.state.exists() else (-1, [], [], [])
        held = Tracked(self.k)
        for x, n, e in zip(*old, strict=True):
            held.add(x, n, e)
        for batch in rows:
            sums = batch.groupby("key", sort=True)["w"].sum()
            for x, w in zip(sums.index.tolist(), sums.tolist(), strict=True):
                held.add(x, w)
        table = [[x, n, held.error[x]] for x, n in held.count.items()]
        self.state.update((at + 1, *([r[i] for r in table] for i in range(3))))
        yield pd.DataFrame([(key[0], key[1], at + 1, *r) for r in table], columns=["series", "salt", "at", "key", "cnt", "err"])

    def close(self) -> None:
        pass


def tracked(stream: DataFrame, key: str, k: int = 100, weight: str | None = None, series: str | None = None, salts: int = SALTS) -> DataFrame:
    """``(series, salt, at, key, cnt, err)``: what Space-Saving tracks of each series, in ``salts`` states of k keys each.

    A key is in one state alone, so states are joined without error: see :func:`hitters`.  Null keys and weights that are not positive are left out.
    """
    from .closing import summed

    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    name = F.lit(None).cast("string") if series is None else F.col(series).cast("string")
    rows = stream.select(name.alias("series"), F.col(key).cast("string").alias("key"), w.alias("w")).where(F.col("key").isNotNull() & (F.col("w") > 0))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    kinds = "series string, salt int, at bigint, key string, cnt double, err double"
    return summed(rows, ["series", "salt", "key"], "w").groupBy("series", "salt").transformWithStateInPandas(Hitters(k), kinds, "Update", "None")


def hitters(sent: DataFrame, k: int) -> DataFrame:
    """``(series, key, cnt, err)``: the k keys of each series with the largest counts, of what :func:`tracked` has sent.

    ``cnt - err <= true weight <= cnt``.  Counts of a state add up to its weight, so fewer than k counts of all states pass W/k, and every
    key above W/k is among the k.
    """
    return top_k(last(sent, ["series", "salt"]).drop("salt"), k, "cnt", "key", ["series"]).drop("rk")


# --- registers ---

#: Registers that share a state.
SHARE = 1024


class Registers(StatefulProcessor):
    """Some registers of one series, a byte each; after each batch those that rose are sent."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("registers", "at bigint, packed binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        at, packed = self.state.get() if self.state.exists() else (-1, bytes(SHARE))
        before = np.frombuffer(bytes(packed), np.uint8)
        now = before.copy()
        for batch in rows:
            np.maximum.at(now, batch["reg"].to_numpy(np.int64) % SHARE, batch["rho"].to_numpy().astype(np.uint8))
        self.state.update((at + 1, now.tobytes()))
        rose = np.flatnonzero(now > before)
        n = len(rose)
        if n:
            yield pd.DataFrame({"series": [key[0]] * n, "at": [at + 1] * n, "reg": rose + key[1] * SHARE, "old": before[rose].astype(np.int32), "new": now[rose].astype(np.int32)})

    def close(self) -> None:
        pass


def register_changes(stream: DataFrame, key: str, series: str | None = None) -> DataFrame:
    """``(series, at, reg, old, new)``: the registers that each micro-batch raised, and from what to what.

    ``at`` counts the batches of a share of ``SHARE`` registers.  The largest ``new`` of each register is the sketch.
    """
    reg, rho = hll.address(F.col(key))
    name = F.lit(None).cast("string") if series is None else F.col(series).cast("string")
    rows = stream.where(F.col(key).isNotNull()).select(name.alias("series"), reg.alias("reg"), rho.alias("rho"))

    def highest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.groupby(["series", "reg"], dropna=False, sort=False, as_index=False)["rho"].max()

    some = rows.mapInPandas(highest, "series string, reg int, rho int").withColumn("share", F.expr(f"reg div {SHARE}").cast("int"))
    return some.groupBy("series", "share").transformWithStateInPandas(Registers(), "series string, at bigint, reg int, old int, new int", "Append", "None")
