"""Sliding windows by exponential histograms, and their exact cousins.

A histogram deals the events of the last ``window`` ticks into buckets, small ones for new events and ever larger ones for old
events.  The invariant: a bucket holds at most ``newer / (k / 2 + 1) + 1`` events, where ``newer`` counts the events after it, so what a
query cannot split at its far end is a small part of what it counts.  Sizes are powers of two, ``k / 2 + 1`` buckets of each, and
an event's bucket follows from its rank from the newest on: no event waits for another one.

A bucket's sketch is any sketch of this package, grouped by ``series`` and ``slot``; :func:`collapse` merges those that answer.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ddsketch import DDSketch
from .frames import as_list, join_null_safe, same, union
from .heavy import Coco, each_group
from .hll import HLL
from .kll import KLL
from .linear import Linear, Shape
from .univmon import Pyramid, UnivMon

#: Parts of a window that are ranked alone.
SLICES = 1024
BUCKET = ["series", "slot"]


def per_size(k: int) -> int:
    """Buckets of each size."""
    return k // 2 + 1


def ranked(df: DataFrame, ts: str, by: str | None = None, window: int = 100_000, ties: Iterable[str] = ()) -> DataFrame:
    """``df``'s events of the last ``window`` ticks of their series, with ``series`` and ``_rank``, 0 for the newest.

    Events without a time are left out.  Events of equal times are ranked by the columns ``ties``.  A window is ranked slice by
    slice, each shifted by the events of newer ones, so no task holds a series.
    """
    t = F.col(ts).cast("bigint")
    rows = df.where(F.col(ts).isNotNull()).withColumn("series", F.lit("") if by is None else F.col(by).cast("string"))
    last = rows.groupBy("series").agg(F.max(t).alias("_last"))
    rows = join_null_safe(rows, last, ["series"]) if by else rows.crossJoin(F.broadcast(last.select("_last")))
    rows = rows.where(t >= F.col("_last") - window).withColumn("_slice", F.floor((F.col("_last") - t) * SLICES / (window + 1)).cast("int"))
    counts = rows.groupBy("series", "_slice").agg(F.count("*").alias("_n"))
    newer = Window.partitionBy("series").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("series", "_slice", F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_shift"))
    own = Window.partitionBy("series", "_slice").orderBy(t.desc(), *[F.col(x) for x in ties])
    both = join_null_safe(rows.withColumn("_own", F.row_number().over(own) - 1), shift, ["series", "_slice"])
    return both.withColumn("_rank", (F.col("_own") + F.col("_shift")).cast("bigint")).drop("_last", "_slice", "_own", "_shift")


def assigned(df: DataFrame, ts: str, by: str | None = None, k: int = 50, window: int = 100_000, ties: Iterable[str] = ()) -> DataFrame:
    """:func:`ranked` events with ``series`` and ``slot``, the bucket by counts: 0 is the newest."""
    if k < 2 or window < 0:
        raise ValueError("k is 2 at least, the window not negative")
    return with_slot(ranked(df, ts, by, window, ties), per_size(k)).drop("_rank")


def leaves(df: DataFrame, ts: str, by: str | None = None, window: int = 100_000, ties: Iterable[str] = (), leaf: int = 8) -> DataFrame:
    """:func:`ranked` events with ``series`` and ``slot``, ``leaf`` events to each: what :func:`by_l2_tree` unites."""
    return ranked(df, ts, by, window, ties).withColumn("slot", F.expr(f"cast(_rank div {leaf} AS int)")).drop("_rank")


def with_slot(ranked: DataFrame, c: int) -> DataFrame:
    """``slot`` of each ``_rank``: level l has ranks from ``c (2^l - 1)`` on, in ``c`` buckets of ``2^l``."""
    out = ranked.withColumn("_level", F.length(F.bin(F.expr(f"_rank div {c} + 1"))) - 1).withColumn("_size", F.expr("shiftleft(1L, _level)"))
    return out.withColumn("slot", F.expr(f"cast(_level * {c} + (_rank - {c} * (_size - 1)) div _size as int)")).drop("_level", "_size")


def buckets(events: DataFrame, ts: str) -> DataFrame:
    """``(series, slot, min_ts, max_ts, size)`` of :func:`assigned` events."""
    t = F.col(ts).cast("bigint")
    return events.groupBy(*BUCKET).agg(F.min(t).alias("min_ts"), F.max(t).alias("max_ts"), F.count("*").alias("size"))


def between(found: DataFrame, t1: int, t2: int) -> DataFrame:
    """The buckets that answer for ``t1 .. t2``: those that reach into it.

    One that begins before t1 answers only where t1 is no nearer to its end than to its beginning, or if it is the only one.
    """
    reach = found.where((F.col("max_ts") >= t1) & (F.col("min_ts") <= t2))
    late = (F.col("min_ts") < t1) & (t1 - F.col("min_ts") > F.col("max_ts") - t1)
    others = F.count("*").over(Window.partitionBy("series"))  # as many as a series has buckets
    return reach.withColumn("_others", others).where(~late | (F.col("_others") == 1)).drop("_others")


def count_between(found: DataFrame, t1: int, t2: int) -> DataFrame:
    """``(series, count)`` of the buckets that answer."""
    return between(found, t1, t2).groupBy("series").agg(F.sum("size").alias("count"))


def collapse(sketch: object, answering: DataFrame) -> object:
    """A sketch grouped by ``series`` and ``slot``, of the buckets in ``answering`` alone, merged into one a series."""
    if "slot" not in sketch.by:
        raise ValueError("the sketch has no buckets")
    keys = answering.select(*BUCKET).distinct()
    kept = lambda t: join_null_safe(t, keys, BUCKET, "inner").drop("slot")
    by = tuple(b for b in sketch.by if b != "slot")
    if isinstance(sketch, Linear):
        return replace(sketch, cells=kept(sketch.cells).groupBy(*by, "row", "col").agg(F.sum("v").alias("v")), by=by)
    if isinstance(sketch, HLL):
        return replace(sketch, registers=kept(sketch.registers).groupBy(*by, "reg").agg(F.max("rho").alias("rho")), by=by)
    if isinstance(sketch, DDSketch):
        return replace(sketch, buckets=kept(sketch.buckets), summary=kept(sketch.summary), by=by).merge()
    if isinstance(sketch, KLL):
        return replace(sketch, items=kept(sketch.items), counts=kept(sketch.counts), by=by).merge()
    if isinstance(sketch, Coco):
        return replace(sketch, table=kept(sketch.table), by=by).merge()
    if isinstance(sketch, (UnivMon, Hybrid)):
        tables = {name: kept(t) for name, t in vars(sketch).items() if isinstance(t, DataFrame)}
        inner = {"univmon": collapse(sketch.univmon, answering)} if isinstance(sketch, Hybrid) else {}
        return replace(sketch, **tables, **inner, by=by).merge()
    raise TypeError(f"no merge of {type(sketch).__name__}")


# --- buckets by L2 ---


def by_l2(events: DataFrame, key: str, k: int = 50, shape: Shape = Shape(3, 512, signed=True)) -> DataFrame:
    """``(series, slot, part, l2)``: how :func:`assigned` buckets unite so that each has an L2^2 of at most a k-th of all newer.

    ``part`` numbers the united buckets from the newest on; one that is larger by itself stays alone.  Masses come from Count-Sketches of
    the buckets, whose number and size parameters bound; a series' are united in one place, from the newest on.
    """
    cells = Linear.build(events, key, by=BUCKET, shape=shape).cells
    kind = events.schema["series"].dataType.simpleString()
    mass = lambda m: float(np.median((m * m).sum(axis=1)))

    def unite(rows: pd.DataFrame) -> pd.DataFrame:
        out, held, members, newer = [], None, [], 0.0
        for slot, part in rows.groupby("slot", sort=True):
            one = np.zeros((shape.rows, shape.cols))
            one[part["row"], part["col"]] = part["v"]
            if held is not None and mass(held + one) <= newer / k:
                held, members = held + one, [*members, slot]
                continue
            if held is not None:
                newer += mass(held)
                out.append((members, mass(held)))
            held, members = one, [slot]
        out.append((members, mass(held)))
        table = [(rows["series"].iloc[0], b, i, m**0.5) for i, (bs, m) in enumerate(out) for b in bs]
        return pd.DataFrame(table, columns=["series", "slot", "part", "l2"])

    return each_group(cells, ["series"], unite, f"series {kind}, slot int, part int, l2 double")


def by_l2_tree(events: DataFrame, key: str, k: int = 50, shape: Shape = Shape(3, 512, signed=True)) -> DataFrame:
    """``(series, slot, part, l2)``: how :func:`leaves` unite so that each part has an L2^2 of at most a k-th of all newer, or is one leaf.

    Leaves are summed up a dyadic tree, each node a Count-Sketch of the events below it.  From the newest leaf on, a part takes the largest
    node that stands at its end and that it can bear, then smaller ones: cuts are free, and each costs the tree's depth.  A series' tree is
    bounded by the window and read in one place; tasks sum it up.
    """
    cells = Linear.build(events, key, by=BUCKET, shape=shape).cells
    last = events.agg(F.max("slot")).first()[0]
    levels = F.explode(F.sequence(F.lit(0), F.lit(max(1, int(last or 0) + 1).bit_length() - 1))).alias("level")
    nodes = cells.select("series", levels, "slot", "row", "col", "v").withColumn("node", F.expr("shiftright(slot, level)"))
    nodes = nodes.groupBy("series", "level", "node", "row", "col").agg(F.sum("v").alias("v"))
    kind = events.schema["series"].dataType.simpleString()

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        level, node = rows["level"].to_numpy(np.int64), rows["node"].to_numpy(np.int64)
        order = np.lexsort((node, level))
        at, v = (rows["row"].to_numpy(np.int64) * shape.cols + rows["col"].to_numpy(np.int64))[order], rows["v"].to_numpy(np.float64)[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(level[order]) != 0) | (np.diff(node[order]) != 0)]))
        spans = dict(zip(zip(level[order][first].tolist(), node[order][first].tolist(), strict=True), zip(first.tolist(), np.append(first[1:], len(order)).tolist(), strict=True), strict=True))
        mass = lambda x: float(np.median((x * x).reshape(shape.rows, -1).sum(axis=1)))

        def with_node(held: np.ndarray, lev: int, i: int) -> np.ndarray:
            a, b = spans.get((lev, i), (0, 0))  # a node whose cells cancel out has none
            out = held.copy()
            out[at[a:b]] += v[a:b]
            return out

        end = int(node[level == 0].max()) + 1
        top, out, newer, here, part = int(level.max()), [], 0.0, 0, 0
        while here < end:
            begun, held = here, with_node(np.zeros(shape.rows * shape.cols), 0, here)
            here += 1
            grown = True
            while grown and here < end:
                grown = False
                for lev in range(min(top, (here & -here).bit_length() - 1), -1, -1):
                    more = with_node(held, lev, here >> lev)
                    if mass(more) <= newer / k:
                        held, here, grown = more, here + (1 << lev), True
                        break
            here = min(here, end)
            newer += mass(held)
            out += [(b, part, mass(held) ** 0.5) for b in range(begun, here)]
            part += 1
        return pd.DataFrame([(rows["series"].iloc[0], *x) for x in out], columns=["series", "slot", "part", "l2"])

    return each_group(nodes, ["series"], cut, f"series {kind}, slot int, part int, l2 double")


# --- exact counts that turn into a UnivMon ---

HYBRID = 256


@dataclass(frozen=True)
class Hybrid:
    """Exact counts of groups of under ``limit`` distinct keys, a UnivMon of the others: ``exact`` is ``(*by, key, w)``."""

    exact: DataFrame
    univmon: UnivMon
    limit: int = HYBRID
    by: tuple[str, ...] = ()

    @staticmethod
    def build(df: DataFrame, key: str, weight: str | None = None, by: str | Iterable[str] = (), limit: int = HYBRID, pyramid: Pyramid = Pyramid()) -> Hybrid:
        by = as_list(by)
        w = F.lit(1) if weight is None else F.col(weight)
        counts = df.where(F.col(key).isNotNull()).groupBy(*by, F.col(key).cast("string").alias("key")).agg(F.sum(w.cast("bigint")).alias("w")).where("w <> 0")
        return _split(counts, by, limit, pyramid, None)

    def merge(self, *others: Hybrid) -> Hybrid:
        """Counts add.  A group that has a UnivMon in one of them, or too many keys in all, gets one of all."""
        same((self.limit, self.by), *((o.limit, o.by) for o in others))
        counts = union([o.exact for o in (self, *others)]).groupBy(*self.by, "key").agg(F.sum("w").alias("w"))
        return _split(counts, list(self.by), self.limit, self.univmon.pyramid, self.univmon.merge(*(o.univmon for o in others)))

    def kinds(self) -> DataFrame:
        """``(*by, exact, keys)``; ``keys`` of exact groups alone."""
        exact = self.exact.groupBy(*self.by).agg(F.lit(True).alias("exact"), F.count("*").alias("keys")).where("keys > 0")
        return exact.unionByName(self.univmon.total.select(*self.by, F.lit(False).alias("exact"), F.lit(None).cast("bigint").alias("keys")))

    def l2(self) -> DataFrame:
        """``(*by, l2)``, exact for exact groups."""
        exact = self.exact.groupBy(*self.by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l2")).where("l2 is not null")
        return exact.unionByName(self.univmon.l2())

    def frequency(self, probes: DataFrame, key: str) -> DataFrame:
        """``(*by, key, cnt)`` of each distinct probe."""
        by = list(self.by)
        wanted = probes.select(*by, F.col(key).cast("string").alias(key)).distinct()
        large = self.univmon.total.select(*by, F.lit(True).alias("_large"))
        exact = join_null_safe(wanted, self.exact.withColumnRenamed("key", key), [*by, key], "left")
        both = join_null_safe(exact, self.univmon.frequency(wanted, key), [*by, key], "left")
        marked = join_null_safe(both, large, by, "left") if by else both.crossJoin(F.broadcast(self.univmon.total.agg((F.count("*") > 0).alias("_large"))))
        return marked.select(*by, key, F.coalesce(F.when(F.coalesce("_large", F.lit(False)), F.col("cnt")).otherwise(F.col("w")), F.lit(0)).cast("bigint").alias("cnt"))


def _split(counts: DataFrame, by: list[str], limit: int, pyramid: Pyramid, before: UnivMon | None) -> Hybrid:
    """Groups of under ``limit`` keys stay counts, unless ``before`` has them; the others' counts go into a UnivMon."""
    keys = counts.groupBy(*by).agg((F.count("*") >= limit).alias("_large"))
    marked = join_null_safe(counts, keys, by) if by else counts.crossJoin(F.broadcast(keys))
    if before is not None:
        had = before.total.select(*by, F.lit(True).alias("_had")) if by else before.total.agg((F.count("*") > 0).alias("_had"))
        marked = join_null_safe(marked, had, by, "left") if by else marked.crossJoin(F.broadcast(had))
        marked = marked.withColumn("_large", F.col("_large") | F.coalesce("_had", F.lit(False))).drop("_had")
    fresh = UnivMon.build(marked.where("_large"), "key", "w", by, pyramid)
    if not by:  # a table without groups has a total even if nothing is in it
        fresh = replace(fresh, total=fresh.total.where("total is not null"))
    whole = fresh if before is None else before.merge(fresh)
    if not by:
        whole = replace(whole, total=whole.total.where("total is not null"))
    return Hybrid(marked.where("not _large").drop("_large"), whole, limit, tuple(by))


def sliding_exact(df: DataFrame, ts: str, width: int, by: str | None = None) -> DataFrame:
    """Each event with the exact number of events of its series in ``ts - width .. ts``."""
    group = Window.partitionBy(*([by] if by else [])).orderBy(F.col(ts).cast("bigint")).rangeBetween(-width, 0)
    return df.withColumn("n", F.count("*").over(group))


# --- buckets in the state of a stream ---


def compacted(rows: list[list[int]], k: int, window: int) -> list[list[int]]:
    """Buckets ``[min_ts, max_ts, size]`` of one series, newest first, united as far as the invariant lets them.

    Those that ended before the window are gone.  Neighbours are one bucket where it holds at most ``newer / (k / 2 + 1) + 1`` events.
    """
    out: list[list[int]] = []
    rows = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)
    newer = 0  # events after the bucket that is being filled
    for low, high, n in rows:
        if high < rows[0][1] - window:
            continue
        if out and out[-1][2] + n <= newer // per_size(k) + 1:
            out[-1] = [min(low, out[-1][0]), max(high, out[-1][1]), out[-1][2] + n]
            continue
        newer += out[-1][2] if out else 0
        out.append([low, high, n])
    return out
