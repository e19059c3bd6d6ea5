"""The emission threshold as a controller of queue depth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.frames import join_null_safe


@dataclass(frozen=True)
class Controller:
    """Moves by ``step`` when the depth predicted for the next tick, ``2 q - previous q``, leaves ``target +- deadband``."""

    start: float = 128.0
    step: float = 1.0
    target: int = 64
    deadband: int = 8
    least: float = 1.0
    most: float = 1024.0

    def adjust(self, tau: float, depth: int, previous: int | None) -> float:
        depth = max(0, depth)
        predicted = 2 * depth - (depth if previous is None else previous)
        if self.step == 0:
            return tau
        if predicted > self.target + self.deadband:
            return min(self.most, tau + self.step)
        if predicted < self.target - self.deadband:
            return max(self.least, tau - self.step)
        return tau


#: Ticks of one block.
BLOCK = 256


def replay(depths: DataFrame, order: str, depth: str, controller: Controller = Controller(), by: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """``(*by, order, depth, tau)`` after each tick; ``order`` is a whole number, ``block`` of which make a block.

    A tick moves tau and clamps it.  Moves with clamps compose: a block of them is one shift with two bounds.  Blocks are composed alone,
    a group's blocks once one after the other, and each block is replayed from where it starts, so no task holds a group's ticks.
    """
    c, keys = controller, [*by, "_block"]
    now = F.greatest(F.col(depth), F.lit(0)).cast("double")
    ticks = depths.select(*by, F.col(order), F.col(depth), now.alias("_now"), F.floor(F.col(order) / block).cast("bigint").alias("_block"))
    ends = ticks.groupBy(*keys).agg(F.max_by("_now", order).alias("_last"))
    ends = ends.select(*keys, F.lag("_last").over(Window.partitionBy(*by).orderBy("_block")).alias("_before"))
    rows = ticks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, depth, "_now"))).alias("_t"))
    rows = join_null_safe(rows, ends, keys)

    def move(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.coalesce("_before", x["_now"])).otherwise(F.get("_t", i - 1)["_now"])
        predicted = 2 * x["_now"] - before
        return F.when(predicted > c.target + c.deadband, c.step).when(predicted < c.target - c.deadband, -c.step).otherwise(0.0).cast("double")

    def clamp(x: Column) -> Column:
        return F.least(F.lit(float(c.most)), F.greatest(F.lit(float(c.least)), x))

    moved = rows.withColumn("_moves", F.transform("_t", move))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    shift = F.aggregate("_moves", start, lambda a, m: F.struct((a["s"] + m).alias("s"), clamp(a["lo"] + m).alias("lo"), clamp(a["hi"] + m).alias("hi")))
    blocks = moved.select(*keys, shift.alias("_f")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_block", "_f"))).alias("_b"))
    first = F.struct(F.lit(float(c.start)).alias("tau"), F.array().cast("array<double>").alias("all"))
    apply = lambda f, x: F.least(f["hi"], F.greatest(f["lo"], x + f["s"]))
    starts = F.aggregate("_b", first, lambda a, x: F.struct(apply(x["_f"], a["tau"]).alias("tau"), F.array_append(a["all"], a["tau"]).alias("all")))["all"]
    at = blocks.select(*by, F.explode(F.arrays_zip("_b", starts.alias("_from"))).alias("z")).select(*by, F.col("z._b._block").alias("_block"), F.col("z._from").alias("_from"))
    here = join_null_safe(moved, at, keys)
    step = lambda a, m: F.struct(clamp(a["tau"] + m).alias("tau"), F.array_append(a["all"], clamp(a["tau"] + m)).alias("all"))
    taus = F.aggregate("_moves", F.struct(F.col("_from").alias("tau"), F.array().cast("array<double>").alias("all")), step)["all"]
    out = here.select(*by, F.explode(F.arrays_zip("_t", taus.alias("_tau"))).alias("z"))
    return out.select(*by, F.col(f"z._t.{order}").alias(order), F.col(f"z._t.{depth}").alias(depth), F.col("z._tau").alias("tau"))
