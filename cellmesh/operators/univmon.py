"""UnivMon: one stream, many metrics.  A pyramid of Count-Sketches over ever smaller samples of keys.

A key is in layers 0 .. b, where b is the number of leading ones among its layer bits.  Cells are ``(*by, layer, row, col, v)``;
each layer also keeps its keys with the largest estimates.  All metrics are recursions over per-layer sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from .frames import SENT_CELLS, as_list, dense, join_null_safe, looked_up, median_of, middle, same, union
from .linear import Shape, addressed, hashed, place


@dataclass(frozen=True)
class Pyramid:
    """``layers`` layers with ``k`` tracked keys each.  The first ``wide`` layers have ``cols`` columns, the others ``narrow``."""

    layers: int = 16
    k: int = 200
    rows: int = 3
    cols: int = 2048
    narrow: int = 512
    wide: int = 8

    def __post_init__(self) -> None:
        if not 1 <= self.layers <= 31 or self.cols & (self.cols - 1) or self.narrow & (self.narrow - 1) or self.narrow > self.cols:
            raise ValueError(f"no such pyramid: {self}")

    @property
    def shape(self) -> Shape:
        """A layer's Count-Sketch; a narrow layer's columns are remainders of these."""
        return Shape(self.rows, self.cols, signed=True)

    def width(self, layer: Column) -> Column:
        return F.when(layer < self.wide, self.cols).otherwise(self.narrow)


def layer_bit(key: Column, i: int | Column) -> Column:
    """Bit i of a key's layer hash (0 .. 31)."""
    return F.getbit(hashing.layer_word(key), F.lit(i) if isinstance(i, int) else i).cast("int")


def bottom_layer(key: Column, layers: int) -> Column:
    """How many of the bits 1, 2, ... are one before the first zero, at most ``layers - 1``."""
    if layers > 31:
        raise ValueError("at most 31 layers")
    ones = F.shiftright(hashing.layer_word(key), 1)  # bits from 1 on
    low_zero = (ones + 1).bitwiseAND(F.bitwise_not(ones))  # the lowest zero bit alone
    return F.least(F.length(F.bin(low_zero)) - 1, F.lit(layers - 1)).cast("int")


@dataclass(frozen=True)
class UnivMon:
    """``top``: ``(*by, layer, key, cnt)``; ``total``: ``(*by, total)``."""

    cells: DataFrame
    top: DataFrame
    total: DataFrame
    pyramid: Pyramid = Pyramid()
    by: tuple[str, ...] = ()
    every: bool = False

    @staticmethod
    def build(df: DataFrame, key: str, weight: str | None = None, by: str | Iterable[str] = (), pyramid: Pyramid = Pyramid(), track: bool = True, every: bool = False) -> UnivMon:
        """Null keys and weights of 0 add nothing.  Without ``track``, no keys are kept: only L1, L2 and frequencies can be asked.

        With ``every``, layers keep all their keys, however many: ``top`` is then a table as large as the keys, and no task ranks it.

        Keys are summed first: the pyramid then costs ``rows * layers`` per distinct key, not per row.
        """
        by = as_list(by)
        w = F.lit(1) if weight is None else F.col(weight)
        sums = df.where(F.col(key).isNotNull()).select(*by, F.col(key).cast("string").alias("key"), w.cast("bigint").alias("w")).groupBy(*by, "key").agg(F.sum("w").alias("w")).where("w <> 0")
        placed = sums.withColumn("layer", F.explode(F.sequence(F.lit(0), bottom_layer(F.col("key"), pyramid.layers))))
        cells = UnivMon._addressed(placed, pyramid).groupBy(*by, "layer", "row", "col").agg(F.sum(F.col("sign") * F.col("w")).alias("v"))
        total = sums.groupBy(*by).agg(F.sum("w").alias("total"))
        plain = UnivMon(cells, placed.select(*by, "layer", "key", F.lit(0).cast("bigint").alias("cnt")).where(F.lit(False)), total, pyramid, tuple(by), every)
        return replace(plain, top=plain._largest(plain._estimates(placed.select(*by, "layer", "key")))) if track else plain

    @staticmethod
    def _addressed(placed: DataFrame, p: Pyramid) -> DataFrame:
        return addressed(placed, "key", p.shape).withColumn("col", F.col("col").bitwiseAND(p.width(F.col("layer")) - 1))

    def _estimates(self, keys: DataFrame) -> DataFrame:
        """``(*by, layer, key, cnt)``: the median estimate of each key in its layer, towards 0.  ``keys`` has each once."""
        p, by = self.pyramid, list(self.by)
        if not by and p.layers * p.rows * p.cols <= SENT_CELLS:
            at = lambda row, col: f"(layer * {p.rows} + {row}) * {p.cols} + {col}"
            table = dense(self.cells.selectExpr(f"{at('row', 'col')} AS at", "v"))
            found = hashed(keys, F.col("key"), p.shape).crossJoin(F.broadcast(table))
            narrow = f"if(layer < {p.wide}, {p.cols - 1}, {p.narrow - 1})"
            values = [looked_up(at(r, f"({col} & {narrow})")) + f" * {sign}" for r, (col, sign) in enumerate(place(p.shape, r) for r in range(p.rows))]
            return found.select("layer", "key", F.expr(f"cast({median_of(values)} as bigint) AS cnt"))
        found = join_null_safe(self._addressed(keys, p), self.cells, [*by, "layer", "row", "col"], "left")
        best = middle(F.collect_list(F.coalesce(F.col("v"), F.lit(0)) * F.col("sign")), p.rows)
        return found.groupBy(*by, "layer", "key").agg(best.cast("bigint").alias("cnt"))

    def _largest(self, estimates: DataFrame) -> DataFrame:
        if self.every:
            return estimates
        rank = Window.partitionBy(*self.by, "layer").orderBy(F.col("cnt").desc(), "key")
        return estimates.withColumn("rk", F.row_number().over(rank)).where(F.col("rk") <= self.pyramid.k).drop("rk")

    def merge(self, *others: UnivMon) -> UnivMon:
        """Cells, tracked counts and totals add; each layer keeps its largest."""
        same((self.pyramid, self.by, self.every), *((o.pyramid, o.by, o.every) for o in others))
        every = [self, *others]
        cells = union([o.cells for o in every]).groupBy(*self.by, "layer", "row", "col").agg(F.sum("v").alias("v"))
        top = union([o.top for o in every]).groupBy(*self.by, "layer", "key").agg(F.sum("cnt").alias("cnt"))
        total = union([o.total for o in every]).groupBy(*self.by).agg(F.sum("total").alias("total"))
        return replace(self, cells=cells, top=self._largest(top), total=total)

    # --- metrics ---

    def layer_l2(self) -> DataFrame:
        """``(*by, layer, l2)``, from the cells of every layer."""
        rows = self.cells.groupBy(*self.by, "layer", "row").agg(F.sum(F.col("v") * F.col("v")).alias("m"))
        return rows.groupBy(*self.by, "layer").agg(F.sqrt(F.median("m")).alias("l2"))

    def l1(self) -> DataFrame:
        return self.total.select(*self.by, F.col("total").cast("double").alias("l1"))

    def l2(self) -> DataFrame:
        return self.layer_l2().where("layer = 0").drop("layer")

    def frequency(self, probes: DataFrame, key: str) -> DataFrame:
        """``(*by, key, cnt)`` from layer 0."""
        keys = probes.select(*self.by, F.col(key).cast("string").alias("key"), F.lit(0).alias("layer")).distinct()
        return self._estimates(keys).drop("layer").withColumnRenamed("key", key)

    def g_sum(self, g: Callable[[Column], Column], threshold: bool = False) -> DataFrame:
        """``(*by, g_sum)``: the sum of g over keys' counts, as ``Y_i = 2 Y_(i+1) + sum of (1 - 2 bit_(i+1)) g(count)`` from the last layer up.

        With ``threshold``, counts up to 1 % of their layer's L2 are left out.
        """
        last = self.pyramid.layers - 1
        rows = self.top
        if threshold:
            rows = join_null_safe(rows, self.layer_l2(), [*self.by, "layer"], "left").where(F.col("cnt") > F.floor(F.coalesce("l2", F.lit(0.0)) * 0.01))
        factor = F.when(F.col("layer") == last, 1).otherwise(1 - 2 * layer_bit(F.col("key"), F.col("layer") + 1))
        sums = rows.groupBy(*self.by, "layer").agg(F.sum(factor * g(F.col("cnt").cast("double"))).alias("s"))
        layers = sums.groupBy(*self.by).agg(F.map_from_entries(F.collect_list(F.struct("layer", "s"))).alias("m"))  # one entry per layer
        y = F.aggregate(F.sequence(F.lit(last), F.lit(0)), F.lit(0.0), lambda acc, i: 2 * acc + F.coalesce(F.element_at("m", i), F.lit(0.0)))
        return layers.select(*self.by, y.alias("g_sum"))

    def entropy(self) -> DataFrame:
        """``(*by, entropy)`` in bits: ``log2 N - gsum(x log2 x) / N``."""
        g = self.g_sum(lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0))
        return join_null_safe(g, self.total, list(self.by)).select(*self.by, (F.log2("total") - F.col("g_sum") / F.col("total")).alias("entropy"))

    def cardinality(self) -> DataFrame:
        return self.g_sum(lambda x: F.lit(1.0), threshold=True).withColumnRenamed("g_sum", "cardinality")

    def top_k(self, k: int) -> DataFrame:
        """``(*by, key, cnt, rk)``: counts above 1 % of their layer's L2, the deepest layer's count of each key."""
        rows = join_null_safe(self.top, self.layer_l2(), [*self.by, "layer"], "left").where(F.col("cnt") > F.floor(F.coalesce("l2", F.lit(0.0)) * 0.01))
        best = rows.groupBy(*self.by, "key").agg(F.max_by("cnt", "layer").alias("cnt"))
        rank = Window.partitionBy(*self.by).orderBy(F.col("cnt").desc(), "key")
        return best.withColumn("rk", F.row_number().over(rank)).where(F.col("rk") <= k)

