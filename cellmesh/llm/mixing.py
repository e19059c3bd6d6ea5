"""Mixing sources to target weights by pivotal dependent rounding, with Spark expressions alone.

A document of a source with target T and size S should be taken T/S times.  Whole copies are given outright.
The fractions are rounded in pairs: a pair moves expected words from one document to the other, in a direction
drawn so that expectations hold, until one has 0 or 1 copies more.  What stays fractional goes up a reduction
tree: blocks of bounded size at each level, one unit left of each, until each source has one unit, which is
drawn alone.  Expected words are moved, not copies, so a source's taken words miss its target by less than one
document, and units go by falling size, so by a small one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash

#: Units that one task rounds in a row.
BLOCK = 256


def words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ceiling: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources by code point, null last, weigh ``weights``, repeating, and share the sum of all sizes.  A target
    stops at ``ceiling`` times its source's size; the excess goes to the others by weight.  That is
    ``min(ceiling * size, level * weight)`` for the one level at which the targets sum to the total, found
    with sums over sources in the order of size/weight.  One row per source, so the table is small.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - ceiling * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = sizes.select("*", w.alias("w"), F.sum("source_size").over(every).alias("total"))
    # The first source that the level of those from it on does not fill sets the level.
    rows = rows.withColumn("level", level)
    stays = F.col("level") * F.col("w") <= ceiling * F.col("source_size")
    found = rows.withColumn("final", F.max(F.when(stays, F.struct(-F.col("source_size") / F.col("w"), "level"))).over(every)["level"])
    target = F.least(F.lit(ceiling) * F.col("source_size"), F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("w"))
    return found.withColumn("target", target).drop("w", "total", "level", "final")


def draw(*parts: Column | str) -> Column:
    """A number in [0, 1) that the parts determine."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


EPS = 1e-9


def _round_block(units: Column, seed: int, key: str) -> Column:
    """Fold an array of units, large ones first so that what stays is small: ``(rest, done)``, the one fractional unit left, or null, and decisions."""
    unit, done = f"struct<key:{key},size:bigint,p:double>", f"array<struct<key:{key},up:int>>"

    def step(acc: Column, u: Column) -> Column:
        held = acc["rest"]
        a, b = held["size"], u["size"]
        to_held = F.least((1 - held["p"]) * a, u["p"] * b)  # words that can go from u to the held unit
        to_u = F.least(held["p"] * a, (1 - u["p"]) * b)
        moved = F.when(draw(held["key"], u["key"], F.lit(seed)) * (to_held + to_u) < to_u, to_held).otherwise(-to_u)
        pair = F.array(
            F.struct(held["key"].alias("key"), a.alias("size"), (held["p"] + moved / a).alias("p")),
            F.struct(u["key"].alias("key"), b.alias("size"), (u["p"] - moved / b).alias("p")),
        )
        whole = lambda x: (x["p"] < EPS) | (x["p"] > 1 - EPS)
        left = F.get(F.filter(pair, lambda x: ~whole(x)), F.lit(0))
        out = F.transform(F.filter(pair, whole), lambda x: F.struct(x["key"].alias("key"), F.when(x["p"] > 0.5, 1).otherwise(0).alias("up")))
        return F.when(held.isNull(), F.struct(F.struct(u["key"].alias("key"), b.alias("size"), u["p"].alias("p")).cast(unit).alias("rest"), acc["done"].alias("done"))).otherwise(
            F.struct(left.cast(unit).alias("rest"), F.concat(acc["done"], out).cast(done).alias("done"))
        )

    return F.aggregate(units, F.struct(F.lit(None).cast(unit).alias("rest"), F.array().cast(done).alias("done")), step)


def pivotal_round(units: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """``group, key, up`` (0 or 1) from ``group, key, size > 0, 0 < p < 1, n``, with distinct keys in a group of at most n units.

    Each level of the tree deals the units of a group by a hash of the key into ``ceil(n / block)`` blocks.
    """
    key = units.schema["key"].dataType.simpleString()
    most = units.agg(F.max("n")).first()[0] or 0
    left, outs, level = units, [], 0
    while True:
        spread = F.pmod(F.xxhash64("key", F.lit(seed + level)), F.ceil(F.col("n") / block).cast("long"))
        folded = (
            left.groupBy("group", spread.alias("block"))
            .agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "key", "size", "p"))).alias("units"), F.ceil(F.max("n") / block).cast("long").alias("n"))
            .select("group", "n", _round_block(F.col("units"), seed + level, key).alias("r"))
        )
        folded = stash(folded, f"mixing-{level}")
        outs.append(folded.select("group", F.explode("r.done").alias("d")).select("group", "d.key", "d.up"))
        left = folded.where("r.rest is not null").select("group", "r.rest.key", "r.rest.size", "r.rest.p", "n")
        if most <= block:
            break
        most, level = math.ceil(most / block), level + 1
    outs.append(left.select("group", "key", F.when(draw(F.col("key"), F.lit(seed - 1)) < F.col("p"), 1).otherwise(0).alias("up")))
    return reduce(DataFrame.unionByName, outs)


def mix(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = (5, 2, 1), ceiling: float = 3.0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, size, text_hash, source_size, target, row, copies, taken``, one row per document.

    ``row`` numbers the rows that repeat an id, source and text, from 1.
    Rows with equal id, source, size and text are rounded as one unit, and its copies are dealt evenly to them,
    so repeated rows have a defined result and cannot pile up in one block.  A null text has size 0; a document
    of size 0 is taken floor(T/S) times (0 words).  Null sources form one source.  An empty table gives no rows.
    Reruns agree: every draw is a hash of keys and the seed.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), F.xxhash64(text).alias("text_hash"))
    units = stash(narrow.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("rows")), "mixing-units")
    aims = stash(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n")), weights, ceiling), "mixing-targets")
    joined = units.join(aims.withColumnRenamed("source", "of"), units["source"].eqNullSafe(F.col("of"))).drop("of")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(ceiling)))).otherwise(0.0)
    # Ratios within EPS of a whole number are whole.
    exact = F.when(F.abs(F.col("rows") * ratio - F.round(F.col("rows") * ratio)) < EPS, F.round(F.col("rows") * ratio)).otherwise(F.col("rows") * ratio)
    wanted = joined.withColumn("x", exact).withColumn("base", F.floor("x").cast("long")).withColumn("p", F.col("x") - F.col("base"))
    wanted = stash(wanted.withColumn("key", F.struct("doc_id", "text_hash", "size")), "mixing-wanted")
    fractional = wanted.where((F.col("p") > 0) & (F.col("size") > 0)).select(F.col("source").alias("group"), "key", "size", "p", "n")
    rounded = pivotal_round(fractional, seed).select(F.col("group").alias("of"), F.col("key").alias("rounded"), "up")
    both = wanted.join(rounded, (F.col("key") == F.col("rounded")) & F.col("source").eqNullSafe(F.col("of")), "left")
    total = both.withColumn("k", F.col("base") + F.coalesce("up", F.lit(0)))
    # The k copies of a unit go evenly to its rows.
    each = total.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = F.floor(F.col("k") / F.col("rows")).cast("long") + F.when(F.col("row") <= F.pmod("k", "rows"), 1).otherwise(0)
    return each.select("doc_id", "source", "size", "text_hash", "source_size", "target", "row", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def repeat(docs: DataFrame, plan: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Each document of ``docs`` as often as its copies in ``plan``, made by :func:`mix` of the same table; its own columns only."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(text).alias("text_hash"))
    same = Window.partitionBy("doc_id", "source", "text_hash").orderBy(F.lit(0))
    left = rows.withColumn("row", F.row_number().over(same)).alias("l")
    right = plan.select("doc_id", "source", "text_hash", "row", "copies").where("copies > 0").alias("r")
    match = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("doc_id", "source", "text_hash")]
    both = left.join(right, [*match, F.col("l.row") == F.col("r.row")])
    return both.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("doc.*")
