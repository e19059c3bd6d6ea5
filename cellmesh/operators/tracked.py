"""A linear sketch beside the keys that it watches: heavy hitters that a table of cells alone cannot name."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import as_list, same, top_k, union
from .heavy import space_saving, space_saving_all
from .linear import Linear, Shape


@dataclass(frozen=True)
class Delta:
    """``cells``: ``(*by, row, col, d)`` of the changes that reach the threshold; ``l1``: ``(*by, row, d)`` in full; ``keys``: ``(*by, key)``.

    ``k``: how many keys a message takes, any number by default.
    """

    cells: DataFrame
    l1: DataFrame
    keys: DataFrame
    k: int | None = None


@dataclass(frozen=True)
class Tracked:
    """``sketch``: Count-Min or Count-Sketch; ``keys``: ``(*by, key)``, at most ``k`` a group, as text; with ``every`` all keys, of which ``k`` go into a message."""

    sketch: Linear
    keys: DataFrame
    k: int = 100
    every: bool = False

    @staticmethod
    def build(df: DataFrame, key: str, weight: str | None = None, by: str | Iterable[str] = (), shape: Shape = Shape(signed=True), k: int = 100, every: bool = False) -> Tracked:
        """Candidates come from Space-Saving: every key above a k-th of a group's weight is among them, or with ``every`` each key."""
        by = as_list(by)
        found = (space_saving_all if every else space_saving)(df, key, k, weight, by)
        return Tracked(Linear.build(df, key, weight, by, shape), found.select(*by, "key"), k, every)

    def estimates(self) -> DataFrame:
        """``(*by, key, cnt)``: the keys' estimates above 0, towards 0."""
        found = self.sketch.estimate(self.keys, "key")
        return found.select(*self.sketch.by, "key", F.col("estimate").cast("bigint").alias("cnt")).where("cnt > 0")

    def top_k(self, k: int | None = None) -> DataFrame:
        """``(*by, key, cnt, rk)``: the largest first, ties by key."""
        return top_k(self.estimates(), self.k if k is None else k, "cnt", "key", self.sketch.by)

    def _kept(self) -> Tracked:
        """The ``k`` keys with the largest estimates by the present cells."""
        return self if self.every else replace(self, keys=self.top_k().select(*self.sketch.by, "key"))

    def merge(self, *others: Tracked) -> Tracked:
        """Cells add; the keys of all are estimated anew from the merged cells, and the largest stay."""
        same((self.k, self.every), *((o.k, o.every) for o in others))
        keys = union([o.keys for o in (self, *others)]).distinct()
        return replace(self, sketch=self.sketch.merge(*(o.sketch for o in others)), keys=keys)._kept()

    def delta(self, before: Tracked | None = None, threshold: float = 0.0) -> Delta:
        """What changed since ``before``, or since nothing: cells by the threshold, row masses and keys in full."""
        by = list(self.sketch.by)
        cells = self.sketch.delta(None if before is None else before.sketch, threshold)
        every = self.sketch.delta(None if before is None else before.sketch)
        return Delta(cells, every.groupBy(*by, "row").agg(F.sum("d").alias("d")), self.keys, self.k if self.every else None)

    def apply(self, *deltas: Delta) -> Tracked:
        """Cells add, those outside the shape are skipped; keys of the deltas are estimated from the merged cells."""
        keys = union([self.keys, *(d.keys for d in deltas)]).distinct()
        return replace(self, sketch=self.sketch.apply(*(d.cells for d in deltas)), keys=keys)._kept()
