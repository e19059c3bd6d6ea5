"""Workers that keep local cells and send them when they reach a threshold, and the aggregator that adds up what is sent.

Any stream of updates: weights, signs, sketch rows admitted before, a threshold for all or one for each item.  :mod:`.deltas` has the closed form for
unit weights.  What is sent and what is held always add up to the exact sketch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .crossing import Blocks, applied
from .ddsketch import DDSketch, Mapping
from .frames import as_list
from .hll import HLL, changes
from .linear import Linear, Shape, addressed

CELL = ["row", "col"]


def crossings(
    df: DataFrame, key: str, order: str, tau: float | str, shape: Shape = Shape(), weight: str | Column | None = None, worker: str | None = None, rows: Column | None = None
) -> DataFrame:
    """``([worker,] row, col, at, d, flush)``: a cell's messages in order, ``at`` the item that made it cross, and at last what it still holds.

    An item adds its weight, with its sign if the shape is signed, to its cells; a cell that reaches ``tau`` (by its size, if signed) is sent and
    starts anew.  ``tau`` is a number, or a column with the threshold at the time of each item.  ``rows``: the sketch rows that admit an item.
    Items of equal order go by key.  ``order`` is a whole number or a timestamp (then ``at`` counts microseconds).  Where a cell crosses is found by sums
    and searches over blocks (:mod:`.crossing`), so weights whose sums are not exact may cross an update early or late.
    """
    own = [] if worker is None else [worker]
    w = F.lit(1.0) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    limit = F.col(tau) if isinstance(tau, str) else F.lit(float(tau))
    items = df.select(*own, F.col(key).alias("_key"), F.col(order).alias("_at"), w.cast("double").alias("_w"), limit.cast("double").alias("_tau"), *([] if rows is None else [rows.alias("_rows")]))
    items = items.where(F.col("_key").isNotNull() & F.col("_w").isNotNull() & (F.col("_w") != 0))
    cells = addressed(items, "_key", shape, None if rows is None else F.col("_rows"))
    cells = cells.select(*own, *CELL, "_at", F.col("_key").cast("string").alias("_key"), (F.col("sign") * F.col("_w")).alias("_w"), "_tau")
    return _sent(cells, [*own, *CELL], shape.signed)


def bucket_crossings(df: DataFrame, value: str, order: str, tau: float | str, mapping: Mapping = Mapping(), worker: str | None = None) -> DataFrame:
    """``([worker,] bucket, at, d, flush)``: the same for DDSketch's buckets, each value one update.  Values that cannot be indexed are left out."""
    own, v = [] if worker is None else [worker], F.col(value).cast("double")
    limit = F.col(tau) if isinstance(tau, str) else F.lit(float(tau))
    items = df.where(mapping.indexable(v)).select(*own, mapping.bucket(v).alias("bucket"), F.col(order).alias("_at"), v.cast("string").alias("_key"), F.lit(1.0).alias("_w"), limit.cast("double").alias("_tau"))
    return _sent(items, [*own, "bucket"], False)


#: Updates of a span of ticks, on average.  A cell's updates in one span are judged alone.
SPAN = 1 << 16


def _sent(cells: DataFrame, names: list[str], signed: bool) -> DataFrame:
    """Messages of the cells that ``names`` name, from their updates ``_at, _key, _w, _tau``.

    Ticks are cut into spans.  First each span of a cell becomes a function of what the cell holds before it; the functions of a
    cell, few and small, are strung together; then each span is run from what its cell holds.  No task holds a cell's stream.
    """
    cells = cells.withColumn("_at", F.unix_micros("_at") if cells.schema["_at"].dataType.typeName() == "timestamp" else F.col("_at").cast("bigint"))
    extent = cells.agg(F.min("_at").alias("low"), F.max("_at").alias("high"), F.count("*").alias("n"), (F.max("row") + 1 if "row" in names else F.lit(1)).alias("rows")).first()
    low, spans = extent["low"] or 0, -(-extent["n"] // (SPAN * (extent["rows"] or 1)))
    width = max(1, -(-((extent["high"] or 0) - low + 1) // max(1, spans)))
    dealt = cells.withColumn("_span", F.expr(f"coalesce(_at - {low}, 0) div {width}"))
    kinds, own = "".join(f"{c} {cells.schema[c].dataType.simpleString()}, " for c in names), [*names, "_span"]
    both = dealt.withColumns({"_held": F.lit(None).cast("double"), "_last": F.lit(spans <= 1)})
    if spans > 1:
        found = _ordered(dealt, own, ["_at", "_key"]).mapInPandas(_functions(names, signed), f"{kinds}_span bigint, _part int, _f string")
        held = _ordered(found, names, ["_span", "_part"]).mapInPandas(_strung(names), f"{kinds}_span bigint, _held double, _last boolean")
        # What a cell holds stands before its updates.
        heads = held.select(*own, F.lit(0).cast("bigint").alias("_at"), F.lit("").alias("_key"), F.lit(0.0).alias("_w"), F.lit(0.0).alias("_tau"), "_held", "_last")
        both = both.unionByName(heads)
    return _ordered(both, own, [F.col("_held").isNull(), "_at", "_key"]).mapInPandas(_messages(names, signed), f"{kinds}at bigint, d double, flush boolean")


def _ordered(df: DataFrame, groups: list[str], order: list) -> DataFrame:
    return df.repartition(*groups).sortWithinPartitions(*groups, *order)


def _starts(batch: pd.DataFrame, names: list[str]) -> np.ndarray:
    """Where the groups of a sorted batch start, and its length."""
    ids = batch.groupby(names, dropna=False, sort=False).ngroup().to_numpy()
    return np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]]).astype(np.int64)


def _named(batch: pd.DataFrame, names: list[str], at: int) -> tuple:
    return tuple(None if pd.isna(x) else x for x in (batch[c].iat[at] for c in names))


def _functions(names: list[str], signed: bool):
    """Spans as functions.  A span that goes on in the next Arrow batch has several, numbered by ``_part``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, here, part = [*names, "_span"], None, 0
        for batch in batches:
            if batch.empty:
                continue
            start = _starts(batch, own)
            blocks = Blocks(batch["_w"].to_numpy(np.float64), batch["_tau"].to_numpy(np.float64), start, signed)
            part = part + 1 if _named(batch, own, 0) == here else 0
            out = batch.iloc[start[:-1]][own].reset_index(drop=True)
            out["_part"] = [part, *[0] * (len(start) - 2)]
            out["_f"] = [json.dumps(blocks.function(k)) for k in range(len(start) - 1)]
            part, here = (part if len(start) == 2 else 0), _named(batch, own, len(batch) - 1)
            yield out

    return run


def _strung(names: list[str]):
    """What a cell holds before each span, and whether that is its last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, span, before, held = None, None, 0.0, 0.0
        for batch in batches:
            if batch.empty:
                continue
            start, out = _starts(batch, names), []
            for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                cell = _named(batch, names, a)
                for at, f in zip(batch["_span"].iloc[a:b].tolist(), batch["_f"].iloc[a:b], strict=True):
                    if (cell, at) != (here, span):
                        if here is not None:
                            out.append((*here, span, before, cell != here))
                        held = held if cell == here else 0.0
                        here, span, before = cell, at, held
                    held = applied(json.loads(f), held)
            yield pd.DataFrame(out, columns=[*names, "_span", "_held", "_last"])
        if here is not None:
            yield pd.DataFrame([(*here, span, before, True)], columns=[*names, "_span", "_held", "_last"])

    return run


def _messages(names: list[str], signed: bool):
    """Each span's messages from what its cell holds; behind the last one what is still held."""

    def table(cells: pd.DataFrame, at: np.ndarray | None, d: np.ndarray) -> pd.DataFrame:
        out = cells[names].reset_index(drop=True)
        out["at"] = pd.array([None] * len(d) if at is None else at, "Int64")
        return out.assign(d=d, flush=at is None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, here, held, last = [*names, "_span"], None, 0.0, None
        for batch in batches:
            if batch.empty:
                continue
            start = _starts(batch, own)
            first = batch.iloc[start[:-1]]
            heads, head = batch["_held"].notna().to_numpy(), first["_held"].notna().to_numpy()
            going_on = _named(batch, own, 0) == here
            if here is not None and not going_on and last["_last"].iat[0]:
                yield table(last, None, np.array([held]))
            entry, ends = first["_held"].fillna(0.0).to_numpy(np.float64), first["_last"].to_numpy(bool)
            if going_on:
                entry[0], ends[0] = held, last["_last"].iat[0]
            items = batch[~heads]
            skipped = np.cumsum(np.concatenate([[0], head]))
            blocks = Blocks(items["_w"].to_numpy(np.float64), items["_tau"].to_numpy(np.float64), start - skipped, signed)
            places, sent, left = blocks.run(entry)
            made = items.iloc[places]
            yield table(made, made["_at"].to_numpy(), sent)
            done = np.flatnonzero(ends[:-1])
            yield table(first.iloc[done], None, left[done])
            here, held = _named(batch, own, len(batch) - 1), float(left[-1])
            last = first.iloc[-1:].assign(_last=bool(ends[-1]))
        if here is not None and last["_last"].iat[0]:
            yield table(last, None, np.array([held]))

    return run


def accounts(sent: DataFrame, worker: str | None = None) -> DataFrame:
    """``([worker,] row, col, messages, emitted, residual)`` of :func:`crossings`; ``messages`` with the last flush of what is held."""
    own = [] if worker is None else [worker]
    held = F.coalesce(F.sum(F.when(F.col("flush"), F.col("d"))), F.lit(0.0))
    emitted = F.coalesce(F.sum(F.when(~F.col("flush"), F.col("d"))), F.lit(0.0))
    count = F.count(F.when(~F.col("flush") | (F.col("d") != 0), 1))
    return sent.groupBy(*own, *CELL).agg(count.alias("messages"), emitted.alias("emitted"), held.alias("residual"))


def aggregated(sent: DataFrame, shape: Shape = Shape(), flushed: bool = True) -> Linear:
    """The sketch of all workers' messages: before the last flush it lags by what they hold, after it it is exact."""
    rows = sent if flushed else sent.where("not flush")
    cells = rows.groupBy(*CELL).agg(F.sum("d").alias("v")).where("v <> 0")
    return Linear(cells, shape)


def register_batches(df: DataFrame, key: str, order: str, tau: int, worker: str | None = None, profile: str = "") -> DataFrame:
    """``([worker,] batch, reg, rho, flush)``: the HyperLogLog rule.  After each ``tau`` rises of registers a worker sends those that rose; registers stay.

    At last all of a worker's registers are sent: ``flush``.  Only rises matter, at most some 50 per register and worker.
    """
    if tau < 1:
        raise ValueError("the threshold is a positive whole number")
    own = as_list(worker or ())
    rises = changes(df, key, order, own, profile)
    number = F.row_number().over(Window.partitionBy(*own).orderBy(order, "reg")) - 1
    group = Window.partitionBy(*own)
    numbered = rises.withColumn("batch", F.floor(number / tau).cast("bigint")).withColumn("_n", F.count("*").over(group))
    full = numbered.where((F.col("batch") + 1) * tau <= F.col("_n")).groupBy(*own, "batch", "reg").agg(F.max("new").alias("rho"))
    last = rises.groupBy(*own, "reg").agg(F.max("new").alias("rho"))
    return full.withColumn("flush", F.lit(False)).unionByName(last.withColumn("batch", F.lit(None).cast("bigint")).withColumn("flush", F.lit(True)))


def aggregated_registers(sent: DataFrame, flushed: bool = True) -> HLL:
    """The largest value of each register that workers sent."""
    rows = sent if flushed else sent.where("not flush")
    return HLL(rows.groupBy("reg").agg(F.max("rho").alias("rho")))


def aggregated_buckets(sent: DataFrame, flushed: bool = True, alpha: float = 0.01) -> DDSketch:
    """The DDSketch of all messages of :func:`bucket_crossings`."""
    rows = sent if flushed else sent.where("not flush")
    return DDSketch.from_buckets(rows.groupBy("bucket").agg(F.sum("d").cast("bigint").alias("cnt")).where("cnt > 0"), alpha=alpha)
