"""A Merkle manifest of a table: a tree over each group's rows, a tree over the groups, and a proof for every row.

Levels are windows.  Nodes of one parent are a window's partition; its ordered full-frame list is the parent's preimage and holds
the siblings that a proof needs.  Of the rows below one node only the first says its digest, so each parent is made once.
``STEP`` levels share one shuffle, by blocks of ``ARITY ** STEP`` nodes; a block's first row stands for it in the next step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash

ARITY = 2
#: Levels to a shuffle.
STEP = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(x: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    said = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*(field(x) for x in fields)), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, start, lambda a, s: F.sha2(F.concat(s["left"], a, s["right"]), 256))


def proof(path: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``idx``, the place in its group ``g`` by ``order`` from 0, and ``n``, the size of the group.

    Rows are dealt by range and counted a range, so no task numbers a whole group.  Rows equal in ``order`` are dealt by their place in the input.
    """
    dealt = nodes.withColumn("tie", F.monotonically_increasing_id())
    keys = ["g", *order, "tie"]
    placed = stash(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n"))
    return placed.join(counts, ["g", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def climbed(nodes: DataFrame, depth: int) -> DataFrame:
    """``depth`` levels up: ``blk`` and ``at`` (block and place in it), ``top`` (digest of the block) and ``path`` (siblings by level).

    A group that has one node left stays as it is.
    """
    block = ARITY**depth
    rows = nodes.withColumns({"blk": F.expr(f"idx div {block}"), "at": F.col("idx") % block, "top": F.col("hash")}).repartition("g", "blk")
    for j in range(depth):
        width, own = ARITY**j, f"CAST(at div {ARITY**j} % {ARITY} AS int)"
        rows = rows.selectExpr(
            "*",
            f"""collect_list(CASE WHEN at % {width} = 0 THEN top END) OVER (
              PARTITION BY g, blk, at div {width * ARITY} ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run""",
        )
        sides = f"named_struct('left', array_join(slice(run, 1, {own}), ''), 'right', array_join(slice(run, {own} + 2, {ARITY}), ''))"
        rows = rows.selectExpr("* EXCEPT (top, run)", f"CASE WHEN n > {width} THEN {sides} END AS side{j}", f"CASE WHEN n > {width} THEN sha2(array_join(run, ''), 256) ELSE top END AS top")
    path = F.filter(F.array(*(f"side{j}" for j in range(depth))), lambda s: s.isNotNull())
    return rows.withColumn("path", path).drop(*(f"side{j}" for j in range(depth)))


def levels(nodes: DataFrame) -> list[tuple[DataFrame, int]]:
    """``nodes`` (``g, idx, n, hash``) and the blocks above them, step by step, each with the levels up to the next; in the last each group has one node."""
    out = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        depth = next((d for d in range(1, STEP) if ARITY**d >= most), STEP)
        out.append((nodes, depth))
        above = climbed(nodes, depth).where("at = 0").select("g", F.col("blk").alias("idx"), F.ceil(F.col("n") / ARITY**depth).cast("long").alias("n"), F.col("top").alias("hash"))
        nodes = stash(above, "merkle-blocks")
        most = -(-most // ARITY**depth)
    return [*out, (nodes, 0)]


def descended(steps: list[tuple[DataFrame, int]], tops: DataFrame) -> DataFrame:
    """The first rows of ``steps`` with the whole path: their own below that of ``tops`` (``g, path`` and other columns)."""
    found = tops.withColumnsRenamed({"path": "rest", "g": "above"}).withColumn("of", F.lit(0).cast("long"))
    carried = [c for c in tops.columns if c not in ("g", "path")]
    for k, (nodes, depth) in reversed(list(enumerate(steps[:-1]))):
        rows = climbed(nodes, depth).join(found, (F.col("g") == F.col("above")) & (F.col("blk") == F.col("of")))
        rows = rows.withColumn("path", F.concat("path", "rest"))
        if k:
            found = stash(rows.select(F.col("g").alias("above"), F.col("idx").alias("of"), F.col("path").alias("rest"), *carried), "merkle-paths")
        else:
            return rows.drop("blk", "at", "top", "above", "of", "rest")
    return steps[0][0].join(found, F.col("g") == F.col("above")).withColumnRenamed("rest", "path").drop("above", "of")


def manifest(rows: DataFrame, group: str = "lang", key: str = "doc_id", digest: str = "leaf") -> DataFrame:
    """``rows`` with ``position``, ``subroot``, ``root`` and ``path`` (array of ``left, right`` from the leaf to the root).

    ``digest`` holds leaf digests.  Leaves of a group ascend by ``key`` (null first), then digest; groups ascend by bytes, null first.
    While more than one node remains, every ``ARITY`` consecutive ones become the SHA-256 of their digests' hex text; a shorter last run
    does too, even one node.  What remains is the group's subroot; subroots become the root likewise.  Equal rows are leaves of their own.
    An empty table gives no rows; the path of a lone row is empty.
    """
    own = F.struct(*(F.col(c) for c in rows.columns)).alias("row")  # in a struct, so that names never clash
    # null before every string, '' included
    nodes = rows.select(own, F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), F.col(key).alias("key"), F.col(digest).alias("hash"))
    below = levels(numbered(nodes, ["key", "hash"]))
    tops = below[-1][0].select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("hash"))
    above = levels(numbered(tops, ["name"]))
    root = above[-1][0].select("g", F.array().cast("array<struct<left: string, right: string>>").alias("path"), F.col("hash").alias("root"))
    named = descended(above, root).select(F.col("name").alias("g"), F.col("hash").alias("subroot"), "root", "path")
    return descended(below, named).select("row.*", F.col("idx").alias("position"), "subroot", "root", "path")
