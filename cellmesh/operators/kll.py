"""KLL quantile sketches as tables of items ``(*by, level, item)``: an item of level l stands for 2^l values.

Each task sketches its own rows batch by batch, and a tree merges tasks' sketches, ``FAN_IN`` of a group at a time, so no task holds
more of a group, nor more than some number of groups at a time.  Ranks, CDFs and quantiles are plain queries over the items.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import as_list, join_null_safe, rounds, same, union
from .heavy import Groups, by_group, each_group

#: Sketches that become one in a step of the reduction tree.
FAN_IN = 128
MOST_K = 26602
#: Ranges of values among which the items of an exact sketch are dealt.
RANGES = 256


class Levels:
    """Items by level, in one process."""

    def __init__(self, k: int, m: int, seed: int):
        self.k, self.m = min(max(k, m), MOST_K), m
        self.levels: list[np.ndarray] = [np.zeros(0)]
        self.coin = np.random.default_rng(seed)

    def capacity(self, level: int) -> int:
        return max(self.m, math.ceil(self.k * (2 / 3) ** (len(self.levels) - 1 - level)))

    def add(self, values: np.ndarray, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append(np.zeros(0))
        self.levels[level] = np.concatenate([self.levels[level], values])

    def compress(self) -> None:
        """Halve each level that is over its capacity; every other of its sorted items goes one level up."""
        h = 0
        while h < len(self.levels):
            items = self.levels[h]
            if len(items) <= self.capacity(h):
                h += 1
                continue
            if h == len(self.levels) - 1:
                self.levels.append(np.zeros(0))  # lower levels shrink with a new top
                h = 0
                continue
            items = np.sort(items)
            self.levels[h] = np.zeros(0)
            self.add(items[int(self.coin.integers(2)) :: 2], h + 1)

    def update(self, values: np.ndarray) -> None:
        for a in range(0, len(values), 4096):
            self.add(values[a : a + 4096])
            self.compress()

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"level": np.repeat(np.arange(len(self.levels)), [len(x) for x in self.levels]).astype(np.int32), "item": np.concatenate(self.levels)})


def _seed(*parts: object) -> int:
    return zlib.crc32(repr(parts).encode())


@dataclass(frozen=True)
class KLL:
    """``items``: ``(*by, level, item)``.  ``counts``: ``(*by, n)``, exact."""

    items: DataFrame
    counts: DataFrame
    k: int = 200
    m: int = 8
    by: tuple[str, ...] = ()
    whole: bool = False

    @staticmethod
    def exact(df: DataFrame, value: str, by: str | Iterable[str] = (), k: int = 4096, m: int = 8) -> KLL:
        """Sketches of blocks of ``k`` rows side by side: none is compacted, so all values are items and all answers exact.

        Items are as many as the values; answers are running sums over ranges of them, which tasks share.
        """
        by, k = as_list(by), min(k, MOST_K)
        blocks = KLL.build(df.select(*by, value, F.expr(f"monotonically_increasing_id() div {k}").alias("_block")), value, [*by, "_block"], k, m)
        return KLL(blocks.items.select(*by, "level", "item"), blocks.counts.groupBy(*by).agg(F.sum("n").alias("n")), k, m, tuple(by), True)

    @staticmethod
    def build(df: DataFrame, value: str, by: str | Iterable[str] = (), k: int = 200, m: int = 8, seed: int = 0) -> KLL:
        """Null values and NaN are left out.  One seed and one layout of the input give one sketch."""
        by = as_list(by)
        rows = df.select(*by, F.col(value).cast("double").alias("item")).where(F.col("item").isNotNull() & ~F.isnan("item"))
        kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)

        def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            held = Groups(lambda key: Levels(k, m, _seed(seed, part, key)))

            def table(states: Iterable[tuple[tuple, Levels]]) -> Iterator[pd.DataFrame]:
                found = [(key, levels.rows()) for key, levels in states]
                if found:
                    out = pd.concat([rows for _, rows in found], ignore_index=True).assign(_part=part)
                    times = [len(rows) for _, rows in found]
                    for i, name in enumerate(by):
                        out[name] = pd.Series([key[i] for key, _ in found]).repeat(times).to_numpy()
                    yield out[[*by, "level", "item", "_part"]]

            for batch in batches:
                for key, rows in by_group(batch, by):
                    held.of(key, len(rows)).update(rows["item"].to_numpy())
                yield from table(held.surplus())
            yield from table(held.states.items())

        parts = rows.mapInPandas(sketch, f"{kinds}level int, item double, _part int")
        levels = rounds(rows, FAN_IN)
        for level in range(1, levels):
            parts = _merged(parts, by, kinds, k, m, seed + 1 + level, F.expr(f"_part div {FAN_IN}").cast("int"))
        merged = _merged(parts, by, kinds, k, m, seed + 1, F.lit(0))
        return KLL(merged.select(*by, "level", "item"), rows.groupBy(*by).agg(F.count("*").alias("n")), k, m, tuple(by))

    def merge(self, *others: KLL, seed: int = 7) -> KLL:
        same((self.k, self.m, self.by, self.whole), *((o.k, o.m, o.by, o.whole) for o in others))
        kinds = "".join(f"{c} {self.items.schema[c].dataType.simpleString()}, " for c in self.by)
        parts = union([o.items for o in (self, *others)])
        counts = union([o.counts for o in (self, *others)]).groupBy(*self.by).agg(F.sum("n").alias("n"))
        if self.whole:
            return replace(self, items=parts, counts=counts)
        return replace(self, items=_merged(parts, list(self.by), kinds, self.k, self.m, seed, F.lit(0)).select(*self.by, "level", "item"), counts=counts)

    # --- queries ---

    def weighted(self) -> DataFrame:
        return self.items.select(*self.by, "item", F.pow(F.lit(2.0), F.col("level")).alias("w"))

    def rank(self, probes: DataFrame, value: str) -> DataFrame:
        """``(*by, value, rank)``: the weight of items up to each probe."""
        if self.whole:
            return self._probed(probes, value).select(*self.by, value, F.col("up_to").alias("rank"))
        probes = probes.select(*self.by, F.col(value)).distinct()
        total = self.weighted().groupBy(*self.by).agg(F.collect_list(F.struct("item", "w")).alias("items"))  # bounded by k
        both = join_null_safe(probes, total, list(self.by), "left")
        weight = F.aggregate(F.filter(F.coalesce("items", F.array().cast("array<struct<item:double,w:double>>")), lambda i: i["item"] <= F.col(value)), F.lit(0.0), lambda a, i: a + i["w"])
        return both.select(*self.by, value, weight.alias("rank"))

    def cdf(self) -> DataFrame:
        """``(*by, value, q)``: values and the share of weight up to them."""
        if self.whole:
            return self._lines().select(*self.by, F.col("x").alias("value"), (F.col("up_to") / F.col("total")).alias("q"))
        steps = self.weighted().groupBy(*self.by, "item").agg(F.sum("w").alias("w"))
        group = Window.partitionBy(*self.by)
        return steps.select(*self.by, F.col("item").alias("value"), (F.sum("w").over(group.orderBy("item")) / F.sum("w").over(group)).alias("q"))

    def _tables(self) -> DataFrame:
        return self.cdf().groupBy(*self.by).agg(F.array_sort(F.collect_list(F.struct("value", "q"))).alias("t"))

    def quantiles(self, qs: Iterable[float], linear: bool = False) -> DataFrame:
        """``(*by, p, value)``: the first value whose share reaches p, or the line between it and the one before."""
        if self.whole:
            step, p = F.struct("q", "value"), F.col("p")
            t = self.cdf().withColumn("p", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).groupBy(*self.by, "p")
            t = t.agg(F.max(F.when(F.col("q") < p, step)).alias("b"), F.min(F.when(F.col("q") >= p, step)).alias("h"), F.max("value").alias("last"))
            line = F.coalesce(F.col("b.value") + (p - F.col("b.q")) / (F.col("h.q") - F.col("b.q")) * (F.col("h.value") - F.col("b.value")), F.col("h.value"))
            return t.select(*self.by, "p", F.coalesce(line if linear else F.col("h.value"), F.col("last")).alias("value"))
        t = self._tables().withColumn("p", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
        at = F.size(F.filter("t", lambda x: x["q"] < F.col("p")))
        return t.select(*self.by, "p", _between(at, "q", "value", F.col("p"), linear, F.element_at("t", -1)["value"]).alias("value"))

    def _lines(self, probes: DataFrame | None = None) -> DataFrame:
        """``(*by, x, w, up_to, total, before, here)`` of each value and probe ``x``: its weight, that up to it and that of all, the value
        before it, and the first from it on with its weight.  Sums and neighbours are found within ranges and carried from range to range.
        """
        by, item = list(self.by), F.when(F.col("w") > 0, F.struct("x", "w"))
        points = self.weighted().select(*by, F.col("item").alias("x"), "w")
        if probes is not None:
            points = points.unionByName(probes.select(*by, "x", F.lit(0.0).alias("w")))
        edges = sorted(set(self.items.approxQuantile("item", [i / RANGES for i in range(1, RANGES)], 0.1 / RANGES)))
        place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("x"))) if edges else F.lit(0)
        points = points.groupBy(*by, "x").agg(F.sum("w").alias("w")).withColumn("_range", place)
        at, back = (Window.partitionBy(*by, "_range").orderBy(o) for o in (F.col("x"), F.desc("x")))
        up, down = (Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_range"), F.desc("_range")))
        ends = points.groupBy(*by, "_range").agg(F.sum("w").alias("_w"), F.max(item["x"]).alias("_last"), F.min(item).alias("_first"))  # a row a range
        ends = ends.select(*by, "_range", F.coalesce(F.sum("_w").over(up), F.lit(0.0)).alias("_below"), F.max("_last").over(up).alias("_last"), F.min("_first").over(down).alias("_first"), F.sum("_w").over(Window.partitionBy(*by)).alias("total"))
        both = join_null_safe(points, ends if by else F.broadcast(ends), [*by, "_range"])
        before = F.coalesce(F.max(item["x"]).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.col("_last"))
        here = F.coalesce(item, F.min(item).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.col("_first"))
        return both.select(*by, "x", "w", (F.col("_below") + F.sum("w").over(at)).alias("up_to"), "total", before.alias("before"), here.alias("here"))

    def _probed(self, probes: DataFrame, value: str) -> DataFrame:
        """:meth:`_lines` of each distinct probe."""
        wanted = probes.select(*self.by, value).distinct().withColumn("x", F.col(value).cast("double"))
        return join_null_safe(wanted, self._lines(wanted), [*self.by, "x"])

    def shares(self, probes: DataFrame, value: str, linear: bool = False) -> DataFrame:
        """``(*by, value, share)``: the share below each probe, 0 and 1 outside; stepwise or linear."""
        if self.whole:
            t = self._probed(probes, value).where("total > 0")
            below, h, b = (F.col("up_to") - F.col("w")) / F.col("total"), F.col("here"), F.col("before")
            line = below + (F.col(value) - b) / (h["x"] - b) * (h["w"] / F.col("total"))
            return t.select(*self.by, value, F.coalesce(line, below).alias("share") if linear else below.alias("share"))
        both = join_null_safe(probes.select(*self.by, value).distinct(), self._tables(), list(self.by), "inner")
        at = F.size(F.filter("t", lambda x: x["value"] < F.col(value)))
        before, here = F.get("t", at - 1), F.get("t", at)
        step = before["q"] if not linear else before["q"] + (F.col(value) - before["value"]) / (here["value"] - before["value"]) * (here["q"] - before["q"])
        return both.select(*self.by, value, F.when(at == 0, 0.0).when(at == F.size("t"), 1.0).otherwise(step).alias("share"))


def regrouped(sketch: KLL, items: DataFrame, counts: DataFrame, by: list[str], bucket: Column, seed: int = 11) -> KLL:
    """Sketches of other groups: ``items``, those of ``sketch`` by ``by``, merge by buckets first and then to one a group."""
    kinds = "".join(f"{c} {items.schema[c].dataType.simpleString()}, " for c in by)
    parts = _merged(items, by, kinds, sketch.k, sketch.m, seed, bucket)
    return replace(sketch, items=_merged(parts, by, kinds, sketch.k, sketch.m, seed + 1, F.lit(0)).select(*by, "level", "item"), counts=counts, by=tuple(by))


def _between(at: Column, x: str, y: str, p: Column, linear: bool, last: Column) -> Column:
    before, here = F.get("t", at - 1), F.get("t", at)
    value = here[y] if not linear else F.when(at == 0, here[y]).otherwise(before[y] + (p - before[x]) / (here[x] - before[x]) * (here[y] - before[y]))
    return F.when(at == F.size("t"), last).otherwise(value)


def _merged(parts: DataFrame, by: list[str], kinds: str, k: int, m: int, seed: int, bucket: Column) -> DataFrame:
    """One sketch per group and bucket, with the bucket as ``_part``."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        key = tuple(rows[by].iloc[0]) if by else ()
        levels = Levels(k, m, _seed(seed, key, int(rows["_bucket"].iloc[0])))
        for level, items in rows.groupby("level")["item"]:
            levels.add(np.sort(items.to_numpy()), int(level))
        levels.compress()
        out = levels.rows()
        for name, v in zip(by, key, strict=True):
            out[name] = v
        out["_part"] = rows["_bucket"].iloc[0]
        return out[[*by, "level", "item", "_part"]]

    return each_group(parts.withColumn("_bucket", bucket), [*by, "_bucket"], merge, f"{kinds}level int, item double, _part int")
