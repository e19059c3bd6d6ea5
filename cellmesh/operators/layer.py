"""Several sketches from one scan, and their answers side by side."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..sources.folders import kept
from . import heavy, kll
from .ddsketch import DDSketch, Mapping
from .frames import Mismatch, UnsupportedQuery, rounds
from .heavy import Coco
from .hll import HLL, register, rest, rho_of
from .kll import KLL
from .linear import Linear, Shape, hashed, place


@dataclass(frozen=True)
class Ranks:
    """A KLL sketch of the key as a number."""

    k: int = 200
    m: int = 8
    seed: int = 0


@dataclass(frozen=True)
class Owners:
    """A Coco table of the key."""

    rows: int = 3
    cols: int = 2048
    seed: int = 0


#: What one Arrow batch or one task says of the cells of all sketches.
CELLS = "sketch string, part int, row int, col int, key string, v double, low bigint"
Kind = Shape | Mapping | Ranks | Owners | str


def build(df: DataFrame, key: str, sketches: dict[str, Kind]) -> dict[str, Linear | HLL | DDSketch | KLL | Coco]:
    """A sketch of ``key`` for each name: a shape makes a Count-Min or Count-Sketch, a mapping a DDSketch, a variant's name a HyperLogLog,
    :class:`Ranks` a KLL and :class:`Owners` a Coco.

    One scan hashes each key once for each way of slicing and deals all sketches' cells.  Cells that add up, or whose least counts, are
    summed by one grouped aggregation.  With sketches whose state depends on the order of arrival a task folds its rows into all of them, and
    what tasks hold is merged by kind.  The cells, which parameters bound, are written to a shared folder: each sketch is a part of them.
    Null keys add nothing; a key that is no number adds nothing to sketches of numbers.
    """
    number = F.expr(f"try_cast(`{key}` AS double)")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), number.alias("_n"))
    entries, shapes = [], {}

    def entry(name: str, row: object = 0, col: str = "0", v: str = "NULL", low: str = "NULL", key: str = "NULL", when: str = "true") -> None:
        title = name.replace("'", "\\'")
        entries.append(f"CASE WHEN {when} THEN named_struct('sketch', '{title}', 'row', {row}, 'col', cast({col} AS int), 'key', cast({key} AS string), 'v', cast({v} AS double), 'low', cast({low} AS bigint)) END")

    for i, (name, made) in enumerate(sketches.items()):
        if isinstance(made, Shape):
            alike = next((n for n, s in shapes.items() if (s.rows, s.cols, s.profile) == (made.rows, made.cols, made.profile)), None)
            if alike is None:
                rows, alike = hashed(rows, F.col("_key"), made).withColumnsRenamed({f"_h{r}": f"_{i}_h{r}" for r in range(made.rows)}), i
            shapes[alike] = made
            for r in range(made.rows):
                col, sign = (x.replace("_h", f"_{alike}_h") for x in place(made, r))
                entry(name, r, col, sign)
        elif isinstance(made, Mapping):
            rows = rows.withColumn(f"_{i}_bucket", F.when(made.indexable(F.col("_n")), made.bucket(F.col("_n"))))
            entry(name, 0, f"_{i}_bucket", "1", when=f"_{i}_bucket IS NOT NULL")
        elif isinstance(made, Ranks):
            entry(name, v="_n", when="_n IS NOT NULL AND NOT isnan(_n)")
        elif isinstance(made, Owners):
            entry(name, v="1", key="_key", when="cast(_key AS string) <> ''")
        else:
            rows = rows.withColumn(f"_{i}_word", hashing.word_of(F.col("_key")))
            rows = rows.withColumns({f"_{i}_reg": register(F.col(f"_{i}_word")), f"_{i}_low": rest(F.col(f"_{i}_word"))})
            entry(name, 0, f"_{i}_reg", low=f"_{i}_low")
    dealt = rows.selectExpr(f"inline(filter(array({', '.join(entries)}), e -> e IS NOT NULL))")
    if ordered := {n: m for n, m in sketches.items() if isinstance(m, (Ranks, Owners))}:
        cells, levels = kept(dealt.mapInPandas(_folded(ordered), CELLS), "layer"), rounds(dealt, kll.FAN_IN)
    else:
        summed = dealt.groupBy("sketch", "row", "col").agg(F.sum("v").alias("v"), F.min("low").alias("low"))
        cells, levels = kept(summed, "layer"), 1
    return {name: _taken(cells.where(F.col("sketch") == name), made, levels) for name, made in sketches.items()}


def _folded(ordered: dict[str, Ranks | Owners]):
    """One task's cells of all sketches: sums and least values of each Arrow batch, and at last the states of those in ``ordered``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        states: dict[str, object] = {n: kll.Levels(m.k, m.m, kll._seed(m.seed, part, ())) if isinstance(m, Ranks) else heavy.Buckets(m.rows, m.cols, (m.seed, part)) for n, m in ordered.items()}
        seen = dict.fromkeys(ordered, 0)
        for batch in heavy.gathered(batches):
            for name in ordered:
                own = batch[batch["sketch"] == name]
                seen[name] += len(own)
                if isinstance(ordered[name], Ranks):
                    states[name].update(own["v"].to_numpy(np.float64))
                else:
                    for x, n in own.groupby("key", sort=False)["v"].sum().items():
                        states[name].add(x, int(n))
            others = batch[~batch["sketch"].isin(list(ordered))]
            if len(others):
                sums = others.groupby(["sketch", "row", "col"], as_index=False).agg(v=("v", "sum"), low=("low", "min"))
                yield sums.assign(part=part, key=None, low=sums["low"].astype("Int64"))[["sketch", "part", "row", "col", "key", "v", "low"]]
        for name, state in states.items():
            if isinstance(ordered[name], Ranks):
                found = state.rows()
                out = pd.DataFrame({"row": found["level"], "col": 0, "key": None, "v": found["item"]})
                out = pd.concat([out, pd.DataFrame({"row": [-1], "col": [0], "key": [None], "v": [float(seen[name])]})])  # how many there were
            else:
                out = state.frame([], ()).rename(columns={"val": "v"})
            yield out.assign(sketch=name, part=part, low=pd.array([None] * len(out), "Int64"), v=out["v"].astype("float64"))[["sketch", "part", "row", "col", "key", "v", "low"]]

    return run


def _taken(own: DataFrame, made: Kind, levels: int) -> object:
    """One sketch of its cells."""
    if isinstance(made, Shape):
        return Linear(own.groupBy("row", "col").agg(F.sum("v").alias("v")), made)
    if isinstance(made, Mapping):
        return DDSketch.from_buckets(own.groupBy(F.col("col").alias("bucket")).agg(F.sum("v").cast("bigint").alias("cnt")), alpha=made.alpha)
    if isinstance(made, Ranks):
        parts = own.where("row >= 0").select(F.col("row").alias("level"), F.col("v").alias("item"), F.col("part").alias("_part"))
        for level in range(1, levels + 1):
            group = F.lit(0) if level == levels else F.expr(f"_part div {kll.FAN_IN}").cast("int")
            parts = kll._merged(parts, [], "", made.k, made.m, made.seed + 1 + level, group)
        counts = own.where("row = -1").agg(F.coalesce(F.sum("v"), F.lit(0.0)).cast("bigint").alias("n"))
        return KLL(parts.select("level", "item"), counts, made.k, made.m)
    if isinstance(made, Owners):
        parts = own.select("row", "col", "key", F.col("v").cast("bigint").alias("val"), F.col("part").alias("_part"))
        for level in range(1, levels):
            parts = heavy._joined(parts.withColumn("_part", F.expr(f"_part div {heavy.FAN_IN}").cast("int")), ["_part"], made.rows, made.cols, made.seed + 2 + level)
        return Coco(parts.drop("_part"), made.rows, made.cols, (), made.seed).merge()
    return HLL(own.groupBy(F.col("col").alias("reg")).agg(rho_of(F.min("low")).alias("rho")), variant=made)


def query(sketches: dict[str, object], probes: DataFrame, key: str, ask: str) -> DataFrame:
    """``(sketch, key, value, error)``: one row per sketch and probe; a sketch that cannot answer says so in ``error``."""
    out = []
    for name, sketch in sketches.items():
        error = None
        if ask == "frequency" and isinstance(sketch, Linear):
            rows = sketch.estimate(probes, key).select(F.col(key).cast("string").alias("key"), F.col("estimate").alias("value"))
        elif ask == "cardinality" and isinstance(sketch, HLL):
            rows = probes.select(F.col(key).cast("string").alias("key")).distinct().crossJoin(F.broadcast(sketch.estimate().select(F.col("estimate").cast("double").alias("value"))))
        elif ask == "frequency" and isinstance(sketch, Coco):
            found = sketch.estimate().withColumn("value", F.col("estimate").cast("double"))
            wanted = probes.select(F.col(key).cast("string").alias("key")).distinct()
            rows = wanted.join(found, "key", "left").select("key", F.coalesce("value", F.lit(0.0)).alias("value"))
        elif ask == "rank" and isinstance(sketch, KLL):
            rows = sketch.rank(probes.select(F.col(key).cast("double").alias("_x")), "_x").select(F.col("_x").cast("string").alias("key"), F.col("rank").alias("value"))
        else:
            error = f"no {ask}"
            rows = probes.select(F.col(key).cast("string").alias("key"), F.lit(None).cast("double").alias("value")).distinct()
        out.append(rows.select(F.lit(name).alias("sketch"), "key", "value", F.lit(error).cast("string").alias("error")))
    return reduce(DataFrame.unionByName, out)


def merge(a: object, b: object) -> object:
    """Merge two sketches of one type."""
    if a is None or b is None or type(a) is not type(b):
        raise Mismatch("only sketches of one type merge")
    return a.merge(b)


def require(ask: str, supported: set[str]) -> None:
    if ask not in supported:
        raise UnsupportedQuery(f"no {ask}")
