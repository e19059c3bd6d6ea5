"""Linear sketches as tables of cells: Count-Min, Count-Sketch and their folded layouts.

A sketch is ``(*by, row, col, v)`` with the cells that are not zero.  Building, merging and applying a delta are all one
grouped sum; tasks sum their own cells first, so a build shuffles at most ``rows * cols`` cells of each task and group.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from .frames import SENT_CELLS, UnsupportedQuery, as_list, dense, join_null_safe, looked_up, median_of, middle, present, same, top_k, union


@dataclass(frozen=True)
class Shape:
    """Parameters that two sketches share before they can be merged.

    ``signed``: Count-Sketch.  ``sample_p``: the share of items that was admitted; ``scaled``: weights were divided by it when
    they were added, so estimates must not be again.
    """

    rows: int = 5
    cols: int = 2048
    signed: bool = False
    profile: str = ""
    sample_p: float = 1.0
    scaled: bool = False

    def __post_init__(self) -> None:
        if self.rows < 1 or self.cols < 1 or not 0 < self.sample_p <= 1:
            raise ValueError(f"no such shape: {self}")
        if self.signed and self.cols & (self.cols - 1):
            raise ValueError("a Count-Sketch has a power of two of columns")

    @property
    def factor(self) -> float:
        return 1.0 if self.scaled else 1.0 / self.sample_p


def names_of(shape: Shape) -> list[str]:
    """The columns that hold a key's hash: as many words as the shape needs."""
    n = {"packed64": 1, "packed128": 2}.get(hashing.hash_mode(shape.rows, shape.cols), shape.rows)
    return [f"_h{i}" for i in range(n)]


def hashed(df: DataFrame, key: Column, shape: Shape) -> DataFrame:
    """``df`` with the words of a key's hash."""
    return df.select("*", *(w.alias(n) for n, w in zip(names_of(shape), hashing.words_of(key, shape.rows, shape.cols, shape.profile), strict=True)))


def place(shape: Shape, row: int) -> tuple[str, str]:
    """SQL of the column and the sign of a row, from the words of :func:`hashed`."""
    names = names_of(shape)
    return hashing.column_sql(names, row, shape.rows, shape.cols), hashing.sign_sql(names, row, shape.rows, shape.cols) if shape.signed else "1"


def addressed(df: DataFrame, key: str, shape: Shape, rows: Column | None = None) -> DataFrame:
    """``df`` once per sketch row, with ``row``, ``col`` and ``sign``.  ``rows``: an array of the rows to address, all by default.

    A key is hashed once, before its rows part.
    """
    entries = "array(" + ", ".join("named_struct('row', {}, 'col', {}, 'sign', {})".format(r, *place(shape, r)) for r in range(shape.rows)) + ")"
    out, own = hashed(df, F.col(key), shape), [f"`{c}`" for c in df.columns]
    if rows is not None:
        out, entries = out.withColumn("_admitted", rows), f"filter({entries}, e -> array_contains(_admitted, e.row))"
    return out.selectExpr(*own, f"inline({entries})")


def best_of(shape: Shape, at: str = "0") -> str:
    """SQL of a key's estimate from :func:`dense` cells, from place ``at`` on: the least of its cells, or the median with signs."""
    values = []
    for r in range(shape.rows):
        col, sign = place(shape, r)
        values.append(looked_up(f"{at} + {r * shape.cols} + {col}") + (f" * {sign}" if shape.signed else ""))
    return median_of(values) if shape.signed else values[0] if len(values) == 1 else f"least({', '.join(values)})"


@dataclass(frozen=True)
class Linear:
    cells: DataFrame
    shape: Shape
    by: tuple[str, ...] = ()

    # --- building and merging ---

    @staticmethod
    def build(df: DataFrame, key: str, weight: str | Column | None = None, by: str | Iterable[str] = (), shape: Shape = Shape(), rows: Column | None = None) -> Linear:
        """Add ``weight`` (1 by default) of each row at its key's cells.

        Rows with a null key or weight, and of weight 0, add nothing.  An empty table gives no cells.
        """
        by = as_list(by)
        w = F.lit(1.0) if weight is None else F.col(weight) if isinstance(weight, str) else weight
        rows_in = df.select(*by, F.col(key).alias("_key"), w.cast("double").alias("_w"), *([] if rows is None else [rows.alias("_rows")]))
        rows_in = rows_in.where(present(F.col("_key"), F.col("_w")) & (F.col("_w") != 0))
        at = addressed(rows_in, "_key", shape, None if rows is None else F.col("_rows"))
        cells = at.groupBy(*by, "row", "col").agg(F.sum(F.col("sign") * F.col("_w")).alias("v"))
        return Linear(cells, shape, tuple(by))

    def merge(self, *others: Linear) -> Linear:
        same((self.shape, self.by), *((o.shape, o.by) for o in others))
        return replace(self, cells=self._summed(union([self.cells, *(o.cells for o in others)])))

    def _summed(self, cells: DataFrame) -> DataFrame:
        return cells.groupBy(*self.by, "row", "col").agg(F.sum("v").alias("v"))

    # --- queries ---

    def estimate(self, probes: DataFrame, key: str) -> DataFrame:
        """``(*by, key, estimate)`` of each distinct probe: the least of its cells, or the median with signs.

        Probes carry the group columns too.  What was sampled and not scaled is scaled here.
        """
        by, shape = list(self.by), self.shape
        wanted = probes.select(*by, F.col(key)).where(F.col(key).isNotNull()).distinct()
        if not by and shape.rows * shape.cols <= SENT_CELLS:
            table = dense(self.cells.selectExpr(f"row * {shape.cols} + col AS at", "v"))
            found = hashed(wanted, F.col(key), shape).crossJoin(F.broadcast(table))
            return found.select(key, F.expr(f"{best_of(shape)} * {shape.factor!r}D AS estimate"))
        found = join_null_safe(addressed(wanted, key, shape), self.cells, [*by, "row", "col"], "left")
        value = F.coalesce(F.col("v"), F.lit(0.0)) * F.col("sign")
        best = middle(F.collect_list(value), shape.rows) if shape.signed else F.min(value)
        return found.groupBy(*by, key).agg((best * shape.factor).alias("estimate"))

    def top_k(self, probes: DataFrame, key: str, k: int) -> DataFrame:
        """The probes with the ``k`` largest estimates above 0, ties by key."""
        return top_k(self.estimate(probes, key).where("estimate > 0"), k, "estimate", key, self.by)

    @staticmethod
    def top(df: DataFrame, key: str, k: int, weight: str | Column | None = None, by: str | Iterable[str] = (), shape: Shape = Shape()) -> DataFrame:
        """The ``k`` keys of ``df`` with the largest estimates of a sketch of it, ties by key.

        The table is read once: keys are summed first, and the sums fill the cells and are the probes.  For keys that repeat.
        """
        by = as_list(by)
        w = F.lit(1.0) if weight is None else F.col(weight) if isinstance(weight, str) else weight
        sums = df.where(F.col(key).isNotNull()).select(*by, F.col(key), w.cast("double").alias("_w")).groupBy(*by, key).agg(F.sum("_w").alias("_w"))
        return Linear.build(sums, key, "_w", by, shape).top_k(sums, key, k)

    def l1(self) -> DataFrame:
        """``(*by, l1)``: the least mass of a row; of Count-Min only."""
        if self.shape.signed:
            raise UnsupportedQuery("signed cells have no L1")
        return self.cells.groupBy(*self.by, "row").agg(F.sum("v").alias("m")).groupBy(*self.by).agg(F.min("m").alias("l1"))

    def l2(self) -> DataFrame:
        """``(*by, l2)``: the root of the median over rows of summed squares; of Count-Sketch only."""
        if not self.shape.signed:
            raise UnsupportedQuery("L2 needs signed cells")
        return self.cells.groupBy(*self.by, "row").agg(F.sum(F.col("v") * F.col("v")).alias("m")).groupBy(*self.by).agg(F.sqrt(F.median("m")).alias("l2"))

    # --- deltas ---

    def delta(self, before: Linear | None = None, threshold: float = 0.0) -> DataFrame:
        """``(*by, row, col, d)``: cells that changed by ``threshold`` or more since ``before`` (by default: since nothing)."""
        if before is None:
            changed = self.cells.withColumnRenamed("v", "d")
        else:
            same((self.shape, self.by), (before.shape, before.by))
            # Signed addition replaces a full outer join: one grouped sum over both snapshots.
            both = self.cells.unionByName(before.cells.withColumn("v", -F.col("v")))
            changed = self._summed(both).withColumnRenamed("v", "d")
        return changed.where((F.col("d") != 0) & (F.abs("d") >= threshold))

    def delta_by_cell(self, before: Linear, thresholds: DataFrame) -> DataFrame:
        """As :meth:`delta`, with ``thresholds(row, col, t)``; a cell without one has threshold 0."""
        d = join_null_safe(self.delta(before), thresholds, ["row", "col"], "left")
        return d.where(F.abs("d") >= F.coalesce("t", F.lit(0.0))).drop("t")

    def apply(self, *deltas: DataFrame) -> Linear:
        """Add deltas; cells outside the shape are skipped."""
        rows, cols = self.shape.rows, self.shape.cols
        inside = [d.where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)).withColumnRenamed("d", "v") for d in deltas]
        return replace(self, cells=self._summed(union([self.cells, *inside])))

    # --- folded layouts: a cell table is the folded form already, a level only names the cell that entries share ---

    def folded(self, level: int) -> DataFrame:
        """``(*by, row, fold_col, col, v)``: entries by the folded column that holds them."""
        if level < 0 or self.shape.cols % (1 << level) or self.shape.cols & (self.shape.cols - 1):
            raise ValueError("columns must be a power of two that the level divides")
        return self.cells.withColumn("fold_col", F.col("col").bitwiseAND(F.lit((self.shape.cols >> level) - 1)))

    def fold_profile(self, level: int) -> DataFrame:
        """``(*by, level, total_entries, used_cells, collided_cells)``."""
        cells = self.folded(level).where("v <> 0").groupBy(*self.by, "row", "fold_col").agg(F.count("*").alias("n"))
        return cells.groupBy(*self.by).agg(
            F.lit(level).alias("level"), F.sum("n").alias("total_entries"), F.count("*").alias("used_cells"), F.count(F.when(F.col("n") > 1, 1)).alias("collided_cells")
        )


    def unfolded(self, level: int, to: int) -> DataFrame:
        """Entries folded at ``level``, scattered to a less folded layout: entries keep their full column."""
        if to > level:
            raise ValueError("unfolding goes to a lower level")
        return Linear(self.folded(level).drop("fold_col"), self.shape, self.by).folded(to)


@dataclass(frozen=True)
class Tally:
    """Count-Min with three counters a cell, ``(*by, row, col, n, total, total2)``: updates, weights, and weights again or their squares."""

    cells: DataFrame
    shape: Shape
    by: tuple[str, ...] = ()

    @staticmethod
    def build(df: DataFrame, key: str, weight: str, by: str | Iterable[str] = (), shape: Shape = Shape(), squares: bool = False) -> Tally:
        """One pass for all three.  ``squares``: ``total2`` adds squared weights; else weights, as sketches made elsewhere do."""
        by = as_list(by)
        rows = df.select(*by, F.col(key).alias("_key"), F.col(weight).cast("double").alias("_w")).where(present(F.col("_key"), F.col("_w")) & (F.col("_w") != 0))
        w = F.col("_w")
        cells = addressed(rows, "_key", shape).groupBy(*by, "row", "col").agg(F.count("*").alias("n"), F.sum(w).alias("total"), F.sum(w * w if squares else w).alias("total2"))
        return Tally(cells, shape, tuple(by))

    def merge(self, *others: Tally) -> Tally:
        same((self.shape, self.by), *((o.shape, o.by) for o in others))
        cells = union([self.cells, *(o.cells for o in others)]).groupBy(*self.by, "row", "col")
        return replace(self, cells=cells.agg(*(F.sum(c).alias(c) for c in ("n", "total", "total2"))))

    def query(self, probes: DataFrame, key: str, ask: str) -> DataFrame:
        """``(*by, key, estimate)`` for ``frequency``, ``sum`` (by size) or ``sum2``: the least over rows."""
        value = {"frequency": F.col("n").cast("double"), "sum": F.abs("total"), "sum2": F.col("total2")}
        if ask not in value:
            raise UnsupportedQuery(f"no {ask}")
        return Linear(self.cells.select(*self.by, "row", "col", value[ask].alias("v")), self.shape, self.by).estimate(probes, key)


def unfold_merge(*tables: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Cells at level 0 of folded tables of any levels: entries keep their full column, so this is a sum."""
    by = as_list(by)
    return union([t.select(*by, "row", "col", "v") for t in tables]).groupBy(*by, "row", "col").agg(F.sum("v").alias("v"))


def rows_of_mask(mask: Column, rows: int) -> Column:
    """The rows of the set bits of a row mask (at most 64)."""
    return F.filter(F.array(*[F.lit(r) for r in range(rows)]), lambda r: F.getbit(mask.cast("bigint"), r) == 1)


def insert_at_rows(df: DataFrame, key: str, mask: str, shape: Shape, value: str | None = None, p: float = 1.0, by: str | Iterable[str] = ()) -> Linear:
    """Rows decided before: add ``value / p`` at the rows of each item's mask."""
    w = (F.lit(1.0) if value is None else F.col(value)) / p
    return Linear.build(df, key, w, by, replace(shape, sample_p=p, scaled=True), rows_of_mask(F.col(mask), shape.rows))
