"""Hydra: sketches of every sub-population of label combinations, in a grid of cells.

A labelled row belongs to all non-empty subsets of its labels.  Each subset key addresses one column in each of D grid rows; the
inner sketch of a cell mixes all keys there, and a query takes the median over the D cells.  The grid is ``(grid_row, grid_col)``
in front of any sketch table of this package, so one grouped build fills all cells.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from .ddsketch import DDSketch, Mapping
from .frames import SENT_CELLS, UnsupportedQuery, dense, median_of, middle, same, union
from .hll import HLL, register, rest, rho_of
from .kll import FAN_IN, KLL, regrouped
from .linear import Linear, Shape, addressed, best_of, hashed, place
from .univmon import Pyramid, UnivMon

GRID = ["grid_row", "grid_col"]
#: What each inner sketch can answer.
SUPPORT = {
    "cm": {"frequency", "l1"},
    "cs": {"frequency", "l2"},
    "hll": {"cardinality"},
    "kll": {"quantile", "cdf"},
    "dd": {"quantile"},
    "universal": {"frequency", "cardinality", "l1", "l2", "entropy"},
}


#: Parts of a key of which all subsets are taken: 2^12 - 1 at most.
MOST_PARTS = 12


def expand_subkeys(key: Column, separator: str = ";") -> Column:
    """All non-empty subsets of a key's parts, in their order; a key of one part or none is its own only subset.

    A key of more than ``MOST_PARTS`` parts is an error.
    """
    parts = F.filter(F.split(key, separator), lambda p: p != "")
    n = F.size(parts)
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2), n) - 1).cast("int"))
    subset = lambda mask: F.array_join(F.filter(parts, lambda p, i: F.getbit(mask.cast("bigint"), i) == 1), separator)
    many = F.raise_error(F.concat(F.lit(f"more than {MOST_PARTS} parts: "), key)).cast("array<string>")
    return F.when(n <= 1, F.array(key)).when(n > MOST_PARTS, many).otherwise(F.transform(masks, subset))


def label_key(*columns: str) -> Column:
    """``name=value`` parts of label columns; null labels are left out."""
    return F.concat_ws(";", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns])


def subkey_sums(df: DataFrame, labels: Column, weight: str | None = None, by: Iterable[str] = ()) -> DataFrame:
    """``(*by, sub, w)``: the weight of each subset key.  There are few: what a frequency grid is built from, and may be probed with.

    Rows of equal labels are summed before their key is expanded.
    """
    by = list(by)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    whole = df.select(*by, labels.alias("_labels"), w.alias("_w")).groupBy(*by, "_labels").agg(F.sum("_w").alias("_w"))
    return whole.select(*by, F.explode(expand_subkeys(F.col("_labels"))).alias("sub"), "_w").groupBy(*by, "sub").agg(F.sum("_w").alias("w"))


def grid_shape(depth: int, width: int) -> Shape:
    return Shape(depth, width)


def routed(subkey: str) -> Column:
    return F.concat(F.lit("grid/"), F.col(subkey))


def placed(df: DataFrame, subkey: str, depth: int, width: int) -> DataFrame:
    """``df`` at the D grid cells of its subset key."""
    at = addressed(df.withColumn("_routed", routed(subkey)), "_routed", grid_shape(depth, width))
    return at.withColumnRenamed("row", "grid_row").withColumnRenamed("col", "grid_col").drop("sign", "_routed")


@dataclass(frozen=True)
class Hydra:
    """``inner``: a grouped sketch by :data:`GRID` (and ``dimension`` with several); ``kind``: what it is; ``big``: one of all rows."""

    inner: object
    kind: str
    depth: int
    width: int
    big: object | None = None
    by: tuple[str, ...] = ()

    @staticmethod
    def build(df: DataFrame, labels: Column, value: str | None = None, weight: str | None = None, kind: str = "cm", depth: int = 3, width: int = 64, big: bool = False, by: Iterable[str] = (), **inner: object) -> Hydra:
        """``labels``: the key of all labels of a row.  ``value`` is what the inner sketch sees: its key, or for quantiles a number.

        Without ``value`` a frequency sketch counts the subset key itself.
        """
        if kind not in SUPPORT:
            raise ValueError(f"no inner sketch {kind}")
        by = list(by)
        if value is None and kind in ("cm", "cs"):
            return Hydra.of_sums(subkey_sums(df, labels, weight, by), kind, depth, width, by, **inner)
        keep = [F.col(c) for c in dict.fromkeys([*by, *([value] if value else []), *([weight] if weight else [])])]
        whole = _inner(df, kind, value, weight, by, inner) if big and value else None
        if value and kind in ("cm", "cs", "kll"):  # a sketch of each label key, which goes to all cells of the key
            own = _inner(df.select(*keep, labels.alias("_labels")), kind, value, weight, [*by, "_labels"], inner)
            return Hydra(_gathered(own, by, depth, width), kind, depth, width, whole, tuple(by))
        if value and kind == "universal":  # a layer sums whole weights by key: so do rows of equal labels
            w = (F.lit(1) if weight is None else F.col(weight)).cast("bigint")
            sums = df.select(*by, F.col(value), labels.alias("_labels"), w.alias("_w")).where(F.col(value).isNotNull()).groupBy(*by, value, "_labels").agg(F.sum("_w").alias("_w"))
            df, weight, labels, keep = sums, "_w", F.col("_labels"), dict.fromkeys([*by, value, "_w"])
        rows = df.select(*keep, F.explode(expand_subkeys(labels)).alias("_sub"))
        grid = placed(rows, "_sub", depth, width)
        return Hydra(_inner(grid, kind, value or "_sub", weight, [*by, *GRID], inner), kind, depth, width, whole, tuple(by))

    @staticmethod
    def of_sums(sums: DataFrame, kind: str = "cm", depth: int = 3, width: int = 64, by: Iterable[str] = (), **inner: object) -> Hydra:
        """A frequency grid of :func:`subkey_sums`."""
        by = list(by)
        return Hydra(_inner(placed(sums, "sub", depth, width), kind, "sub", "w", [*by, *GRID], inner), kind, depth, width, None, tuple(by))

    def merge(self, *others: Hydra) -> Hydra:
        """Grids of one kind and size: the inner sketches merge cell by cell, those of all rows too if each has one."""
        identity = lambda h: (h.kind, h.depth, h.width, h.by, h.big is None)
        same(identity(self), *(identity(o) for o in others))
        return replace(self, inner=self.inner.merge(*(o.inner for o in others)), big=None if self.big is None else self.big.merge(*(o.big for o in others)))

    def query(self, probes: DataFrame, subkey: str, ask: str, **how: object) -> DataFrame:
        """``(*by, subkey, estimate)``: the median over grid rows of the inner answers to ``ask``, for each distinct probe.

        ``how``: ``item`` a column of probes for frequencies of values, ``q`` for quantiles, ``x`` for the CDF.
        """
        if ask not in SUPPORT[self.kind]:
            raise UnsupportedQuery(f"{self.kind} cells have no {ask}")
        by, item = list(self.by), how.get("item")
        wanted = probes.select(*by, subkey, *([item] if item else [])).distinct()
        if ask == "frequency" and isinstance(self.inner, Linear) and not by and self._cells() <= SENT_CELLS:
            return self._looked_up(wanted, subkey, item)
        at = placed(wanted, subkey, self.depth, self.width)
        group = [*by, *GRID]
        if ask == "frequency":
            key = item or subkey
            answers = self.inner.estimate(at, key) if isinstance(self.inner, Linear) else self.inner.frequency(at, key).withColumnRenamed("cnt", "estimate")
            match = [*group, key]
            at = at.withColumn(key, F.col(key).cast("string")) if not isinstance(self.inner, Linear) else at
        else:
            answers = _answer(self.inner, ask, how, group)
            match = group
        both = at.join(answers, match, "left")
        answer = F.coalesce(F.col("estimate").cast("double"), F.lit(0.0))
        return both.groupBy(*by, subkey, *([item] if item else [])).agg(middle(F.collect_list(answer), self.depth).alias("estimate"))

    def _cells(self) -> int:
        return self.depth * self.width * self.inner.shape.rows * self.inner.shape.cols

    def _looked_up(self, wanted: DataFrame, subkey: str, item: str | None) -> DataFrame:
        """Frequencies from the grid as one array: nothing but the array moves."""
        shape, grid = self.inner.shape, grid_shape(self.depth, self.width)
        cells = shape.rows * shape.cols
        table = dense(self.inner.cells.selectExpr(f"(grid_row * {self.width} + grid_col) * {cells} + row * {shape.cols} + col AS at", "v"))
        outer = hashed(wanted, routed(subkey), grid)
        outer = outer.selectExpr(*(f"`{c}`" for c in wanted.columns), *(f"({r * self.width} + {place(grid, r)[0]}) * {cells} AS _g{r}" for r in range(self.depth)))
        inner = hashed(outer, F.col(item or subkey), shape).crossJoin(F.broadcast(table))
        answers = [best_of(shape, f"_g{r}") for r in range(self.depth)]
        return inner.select(*wanted.columns, F.expr(f"{median_of(answers)} * {shape.factor!r}D AS estimate"))


def spread(table: DataFrame, depth: int, width: int) -> DataFrame:
    """A table by ``_labels`` at the grid cells of all subset keys, its rows and columns kept."""
    held = table.withColumnsRenamed({"row": "_row", "col": "_col"}).withColumn("_sub", F.explode(expand_subkeys(F.col("_labels"))))
    return placed(held, "_sub", depth, width).drop("_sub").withColumnsRenamed({"_row": "row", "_col": "col"})


def _gathered(own: Linear | KLL, by: list[str], depth: int, width: int) -> Linear | KLL:
    """Sketches of label keys, merged in the cells of their subset keys."""
    to = [*by, *GRID]
    if isinstance(own, Linear):
        return replace(own, cells=spread(own.cells, depth, width).groupBy(*to, "row", "col").agg(F.sum("v").alias("v")), by=tuple(to))
    counts = spread(own.counts, depth, width).groupBy(*to).agg(F.sum("n").alias("n"))
    return regrouped(own, spread(own.items, depth, width), counts, to, F.expr(f"cast(pmod(xxhash64(_labels), {FAN_IN}) AS int)"))


def _inner(rows: DataFrame, kind: str, value: str | None, weight: str | None, by: list[str], inner: dict) -> object:
    if kind in ("cm", "cs"):
        return Linear.build(rows, value, weight, by, inner.get("shape") or Shape(3, 512, signed=kind == "cs"))
    if kind == "hll":
        return HLL.build(rows, value, by, variant=inner.get("variant", "ertl"))
    if kind == "dd":
        return DDSketch.build(rows, value, by, inner.get("alpha", 0.01))
    if kind == "kll":
        return KLL.build(rows, value, by, k=inner.get("k", 200))
    return UnivMon.build(rows, value, weight, by, inner.get("pyramid") or Pyramid(4, 64, 3, 512, 512))


def _answer(sketch: object, ask: str, how: dict, by: list[str]) -> DataFrame:
    if ask == "quantile":
        return sketch.quantiles([how["q"]]).select(*by, F.col("value").alias("estimate"))
    if ask == "cdf":
        probes = sketch.counts.select(*by).distinct().withColumn("x", F.lit(float(how["x"])))
        return sketch.shares(probes, "x").select(*by, F.col("share").alias("estimate"))
    if isinstance(sketch, HLL):
        return sketch.estimate()
    found = getattr(sketch, ask)()
    return found.select(*by, F.col(ask).alias("estimate"))


def global_answer(sketch: Hydra, ask: str, **how: object) -> DataFrame:
    """``(*by, estimate)``: what the counter of all rows says; ``top_k`` with ``k`` gives ``(*by, key, cnt, rk)``."""
    if sketch.big is None:
        raise UnsupportedQuery("built without a counter of all rows")
    if ask == "top_k":
        if sketch.kind != "universal":
            raise UnsupportedQuery(f"{sketch.kind} cells have no {ask}")
        return sketch.big.top_k(int(how["k"]))
    if ask not in SUPPORT[sketch.kind] - {"frequency"}:
        raise UnsupportedQuery(f"a {sketch.kind} counter of all rows has no {ask}")
    return _answer(sketch.big, ask, how, list(sketch.by))


def multihead(df: DataFrame, labels: Column, dimensions: dict[str, str], weight: str | None = None, kind: str = "cm", depth: int = 3, width: int = 64, **inner: object) -> Hydra:
    """One grid with a counter per dimension: ``dimensions`` names the value column of each.  The extra group column is ``dimension``."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value")) for d, c in dimensions.items()])
    rows = df.select(labels.alias("_labels"), *([weight] if weight else []), F.explode(pairs).alias("_d")).select("_labels", *([weight] if weight else []), "_d.dimension", "_d.value")
    return Hydra.build(rows.where("value is not null"), F.col("_labels"), "value", weight, kind, depth, width, by=["dimension"], **inner)


def multihead_query(sketch: Hydra, probes: DataFrame, subkey: str, dimension: str, ask: str, **how: object) -> DataFrame:
    """``(subkey, [item,] estimate)`` from the counters of one dimension."""
    if isinstance(sketch.inner, Linear) and sketch.by == ("dimension",):
        own = sketch.inner.cells.where(F.col("dimension") == dimension).drop("dimension")
        return replace(sketch, inner=replace(sketch.inner, cells=own, by=tuple(GRID)), big=None, by=()).query(probes, subkey, ask, **how)
    return sketch.query(probes.withColumn("dimension", F.lit(dimension)), subkey, ask, **how).drop("dimension")


@dataclass(frozen=True)
class MultiHead:
    """A grid with a counter of a kind of its own for each dimension, in one table of cells.

    ``cells``: ``(dimension, *GRID, row, col, v, low)``.  Count-Min and Count-Sketch cells and DDSketch buckets add ``v``; HyperLogLog registers
    keep the least ``low``, the rest of a hash.  ``heads`` names the kind of each dimension.
    """

    cells: DataFrame
    heads: tuple[tuple[str, str], ...]
    depth: int
    width: int
    shape: Shape = Shape(3, 512)
    alpha: float = 0.01

    @staticmethod
    def build(df: DataFrame, labels: Column, dimensions: dict[str, tuple[str, str]], weight: str | None = None, depth: int = 3, width: int = 64, shape: Shape = Shape(3, 512), alpha: float = 0.01) -> MultiHead:
        """``dimensions``: of each the column of its values and its kind, ``cm``, ``cs``, ``hll`` or ``dd``.

        One scan fills the cells of all kinds for each label key in one grouped aggregation, and these go to the grid cells of the key.  A null value adds nothing in its
        dimension, nor does a value that a quantile sketch cannot index.  Weights count in ``cm`` and ``cs``.
        """
        if wrong := {kind for _, kind in dimensions.values()} - {"cm", "cs", "hll", "dd"}:
            raise ValueError(f"no such counters: {sorted(wrong)}")
        w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
        values = [F.col(c).alias(f"_value{i}") for i, (c, _) in enumerate(dimensions.values())]
        rows = df.select(w.alias("_w"), *values, labels.alias("_labels"))
        entries, mapping = [], Mapping(alpha)
        for i, (name, (_, kind)) in enumerate(dimensions.items()):
            value, title = F.col(f"_value{i}"), name.replace("'", "\\'")

            def entry(row: object, col: str, v: str, low: str, when: str, title: str = title) -> str:
                return f"CASE WHEN {when} THEN named_struct('dimension', '{title}', 'row', {row}, 'col', cast({col} AS int), 'v', cast({v} AS double), 'low', cast({low} AS bigint)) END"

            if kind in ("cm", "cs"):
                made = replace(shape, signed=kind == "cs")
                rows = hashed(rows, value.cast("string"), made).withColumnsRenamed({f"_h{r}": f"_{i}_h{r}" for r in range(made.rows)})
                for r in range(made.rows):
                    col, sign = (x.replace("_h", f"_{i}_h") for x in place(made, r))
                    entries.append(entry(r, col, f"({sign}) * _w", "NULL", f"_value{i} IS NOT NULL AND _w <> 0"))
            elif kind == "hll":
                rows = rows.withColumn(f"_{i}_word", hashing.word_of(value.cast("string")))
                rows = rows.withColumns({f"_{i}_reg": register(F.col(f"_{i}_word")), f"_{i}_low": rest(F.col(f"_{i}_word"))})
                entries.append(entry(0, f"_{i}_reg", "NULL", f"_{i}_low", f"_value{i} IS NOT NULL"))
            else:
                v = value.cast("double")
                rows = rows.withColumn(f"_{i}_bucket", F.when(mapping.indexable(v), mapping.bucket(v)))
                entries.append(entry(0, f"_{i}_bucket", "1", "NULL", f"_{i}_bucket IS NOT NULL"))
        dealt = rows.selectExpr("_labels", f"inline(filter(array({', '.join(entries)}), e -> e IS NOT NULL))")
        return MultiHead(_tagged(spread(_tagged(dealt, ["_labels"]), depth, width)), tuple((name, kind) for name, (_, kind) in dimensions.items()), depth, width, shape, alpha)

    def merge(self, *others: MultiHead) -> MultiHead:
        identity = lambda m: (m.heads, m.depth, m.width, m.shape, m.alpha)
        same(identity(self), *(identity(o) for o in others))
        return replace(self, cells=_tagged(union([m.cells for m in (self, *others)])))

    def head(self, dimension: str) -> Hydra:
        """The grid of one dimension."""
        kinds = dict(self.heads)
        if dimension not in kinds:
            raise UnsupportedQuery(f"no dimension {dimension}")
        kind, own = kinds[dimension], self.cells.where(F.col("dimension") == dimension)
        if kind in ("cm", "cs"):
            inner = Linear(own.select(*GRID, "row", "col", "v"), replace(self.shape, signed=kind == "cs"), tuple(GRID))
        elif kind == "hll":
            inner = HLL(own.select(*GRID, F.col("col").alias("reg"), rho_of(F.col("low")).alias("rho")), tuple(GRID))
        else:
            inner = DDSketch.from_buckets(own.select(*GRID, F.col("col").alias("bucket"), F.col("v").cast("bigint").alias("cnt")), GRID, self.alpha)
        return Hydra(inner, kind, self.depth, self.width)

    def query(self, probes: DataFrame, subkey: str, dimension: str, ask: str, **how: object) -> DataFrame:
        """``(subkey, [item,] estimate)`` from the counters of one dimension, as :meth:`Hydra.query`."""
        return self.head(dimension).query(probes, subkey, ask, **how)


def _tagged(cells: DataFrame, by: Iterable[str] = tuple(GRID)) -> DataFrame:
    return cells.groupBy("dimension", *by, "row", "col").agg(F.sum("v").alias("v"), F.min("low").alias("low"))
