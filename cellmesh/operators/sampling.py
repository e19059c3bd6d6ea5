"""Which items, keys or sketch rows a sampled sketch admits."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from .frames import as_list, join_null_safe
from .linear import Linear, Shape


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that the parts determine: the first 32 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / float(1 << 32)


def keep_key(key: Column, p: float, salt: str = "keep") -> Column:
    """Value-determined sampling: a key is always kept or never, each with probability ``p``."""
    return F.lit(True) if p >= 1 else F.lit(False) if p <= 0 else uniform(F.lit(salt), key) < p


def admit(item: Column, p: float, salt: str = "item") -> Column:
    """Item sampling with independent items: the gaps between admitted ones are geometric."""
    return F.lit(True) if p >= 1 else uniform(F.lit(salt), item) < max(p, 1e-9)


def admitted_rows(item: Column, rows: int, p: float, salt: str = "row") -> Column:
    """The array of sketch rows that admit an item, each row for itself."""
    every = F.array(*[F.lit(r) for r in range(rows)])
    return every if p >= 1 else F.filter(every, lambda r: uniform(F.lit(salt), item, r) < max(p, 1e-9))


def row_mask(rows: Column) -> Column:
    """The bit mask of an array of rows."""
    return F.aggregate(rows, F.lit(0).cast("bigint"), lambda m, r: m + F.pow(F.lit(2), r).cast("bigint"))


def sampled(df: DataFrame, key: str, item: str, p: float, shape: Shape = Shape(), weight: str | None = None, by: str | Iterable[str] = ()) -> Linear:
    """Whole-item sampling: cells hold what was admitted, queries scale."""
    return Linear.build(df.where(admit(F.col(item), p)), key, weight, by, replace(shape, sample_p=p))


def sampled_per_row(df: DataFrame, key: str, item: str, p: float, shape: Shape = Shape(), weight: str | None = None, by: str | Iterable[str] = ()) -> Linear:
    """Each row admits for itself and adds ``weight / p``: cells are scaled already."""
    w = (F.lit(1.0) if weight is None else F.col(weight)) / p
    return Linear.build(df, key, w, by, replace(shape, sample_p=p, scaled=True), admitted_rows(F.col(item), shape.rows, p))


def nitro(df: DataFrame, key: str, order: str, rate: float = 1.0, shape: Shape = Shape(), by: str | Iterable[str] = ()) -> Linear:
    """Batched sampling: an admitted item at position i of its group's order updates row ``i mod rows`` alone, by ``ceil(1 / rate)``.

    A key's cells then hold about a ``rows``-th of its count: :func:`nitro_estimate` scales.
    """
    import math

    by = as_list(by)
    step = math.ceil(1 / rate)
    rows = positions(df, order, by).where(admit(F.col("position"), rate, "nitro"))
    return Linear.build(rows, key, F.lit(float(step)), by, shape, F.array(F.pmod(F.col("position"), F.lit(shape.rows)).cast("int")))


#: Ranges of an order that are numbered alone.
RANGES = 1024


def positions(df: DataFrame, order: str, by: Iterable[str] = ()) -> DataFrame:
    """``df`` with ``position`` from 0 in the order of a number ``order``, in each group or over the table; null orders come first.

    The span of orders of a group is cut into ``RANGES`` equal ranges; each is numbered alone and shifted by the rows before it, so no task
    numbers a group.  Rows of equal order are numbered in any order.
    """
    by = as_list(by)
    at = F.col(order).cast("double")
    ends = df.groupBy(*by).agg(F.min(at).alias("_low"), F.max(at).alias("_high"))
    marked = join_null_safe(df, ends, by) if by else df.crossJoin(F.broadcast(ends))
    span = F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-300))
    marked = marked.withColumn("_range", F.coalesce(F.least(F.floor((at - F.col("_low")) / span * RANGES), F.lit(RANGES - 1)), F.lit(-1)).cast("int"))
    counts = marked.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(order)) - 1
    both = join_null_safe(marked.withColumn("position", own), shift, [*by, "_range"])
    return both.withColumn("position", (F.col("position") + F.col("_shift")).cast("bigint")).drop("_low", "_high", "_range", "_shift")


def nitro_estimate(sketch: Linear, probes: DataFrame, key: str) -> DataFrame:
    """Estimates times the number of rows, as each item updated one row."""
    return sketch.estimate(probes, key).withColumn("estimate", F.col("estimate") * sketch.shape.rows)


def hash_threshold(df: DataFrame, key: str, p: float) -> DataFrame:
    """The rows of kept keys, by the key's mixed XXH3 hash: the rule for exchange with sketches made elsewhere."""

    @F.pandas_udf("boolean")
    def keep(keys: pd.Series) -> pd.Series:
        kept = {k: keep_by_hash(hashing.xxh3_64(k.encode(), hashing.CANONICAL), p) for k in keys.dropna().unique()}
        return keys.map(kept).fillna(False).astype(bool)

    return df.where(keep(F.col(key).cast("string")))


def keep_by_hash(canonical: int, p: float) -> bool:
    """Whether a key with this canonical hash is kept: its hash, salted and mixed by the splitmix64 finalizer, as a number in [0, 1) below ``p``."""
    if p >= 1 or p <= 0:
        return p >= 1
    word = (1 << 64) - 1
    # The golden-ratio salt and the splitmix64 multipliers.
    x = canonical ^ 0x9E3779B97F4A7C15
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & word
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & word
    return ((x ^ (x >> 31)) >> 11) / float(1 << 53) < p
