"""Count-Min, Count-Sketch, folded layouts, sampling, deltas and emissions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import deltas, heavy, layer, sampling
from ..operators.ddsketch import DDSketch, Mapping
from ..operators.frames import dealt, top_k
from ..operators.heavy import Coco
from ..operators.hll import HLL
from ..operators.linear import Linear, Shape, Tally, insert_at_rows, unfold_merge
from ..operators.tracked import Tracked
from ..sources.tables import load, packets, read, save
from . import sqltext as s
from .registry import query

CS = Shape(signed=True)
USERS = "SELECT user_id FROM events"
CM_EVENTS = s.cells("events", "user_id")
CS_EVENTS = s.cells("events", "user_id", signed=True)


def events(spark, d):
    return read(spark, d, "events")


@query("cm_cells", CM_EVENTS)
def _(spark, d):
    return Linear.build(events(spark, d), "user_id").cells


@query("cm_point_estimate", s.estimates(CM_EVENTS, USERS, "user_id"))
def _(spark, d):
    e = events(spark, d)
    return Linear.build(e, "user_id").estimate(e, "user_id")


_TOP = f"SELECT user_id, estimate, row_number() OVER (ORDER BY estimate DESC, user_id)::INTEGER AS rk FROM ({s.estimates(CM_EVENTS, USERS, 'user_id')}) QUALIFY rk <= 10"


@query("cm_topk_estimate", _TOP)
def _(spark, d):
    return Linear.top(events(spark, d), "user_id", 10)


_LINES = s.cells("lineitem", "l_orderkey", w="l_quantity")


@query("cm_weighted_sum", s.estimates(_LINES, "SELECT l_orderkey FROM lineitem", "l_orderkey"))
def _(spark, d):
    lines = read(spark, d, "lineitem")
    return Linear.build(lines, "l_orderkey", "l_quantity").estimate(lines, "l_orderkey")


@query("cm_l1", f'SELECT min(m) AS l1 FROM (SELECT sum(v) AS m FROM ({_LINES}) GROUP BY "row")')
def _(spark, d):
    return Linear.build(read(spark, d, "lineitem"), "l_orderkey", "l_quantity").l1()


@query("cm_merge_halves", s.cells("lineitem", "l_partkey"))
def _(spark, d):
    lines = read(spark, d, "lineitem")
    a, b = (Linear.build(lines.where(f"l_orderkey % 2 = {i}"), "l_partkey") for i in (0, 1))
    return a.merge(b).cells


@query("cm_nonpow2", s.estimates(s.cells("events", "user_id", 4, 17), USERS, "user_id", 4, 17))
def _(spark, d):
    e = events(spark, d)
    return Linear.build(e, "user_id", shape=Shape(4, 17)).estimate(e, "user_id")


@query("cm_grouped_by_type", s.cells("events", "user_id", 3, 512, by="event_type"))
def _(spark, d):
    return Linear.build(events(spark, d), "user_id", by="event_type", shape=Shape(3, 512)).cells


@query("cm_grouped_estimate", s.estimates(s.cells("events", "user_id", 3, 512, by="event_type"), "SELECT event_type, user_id FROM events", "user_id", 3, 512, by="event_type"))
def _(spark, d):
    e = events(spark, d)
    return Linear.build(e, "user_id", by="event_type", shape=Shape(3, 512)).estimate(e, "user_id")


_EXACT = "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1"
_PLAIN = s.cells("lineitem", "l_orderkey")


@query(
    "cm_error_bound",
    f"""SELECT count(*) AS keys, count(*) FILTER (estimate < n) AS underestimates,
      count(*) FILTER (estimate - n <= exp(1) / 2048 * (SELECT count(*) FROM lineitem)) AS within_bound
      FROM ({s.estimates(_PLAIN, "SELECT l_orderkey FROM lineitem", "l_orderkey")}) JOIN ({_EXACT}) USING (l_orderkey)""",
)
def _(spark, d):
    lines = read(spark, d, "lineitem")
    true = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    both = Linear.build(lines, "l_orderkey").estimate(lines, "l_orderkey").join(true, "l_orderkey")
    total = lines.agg((F.exp(F.lit(1.0)) / 2048 * F.count("*")).alias("bound"))
    under, within = F.count(F.when(F.col("estimate") < F.col("n"), 1)), F.count(F.when(F.col("estimate") - F.col("n") <= F.col("bound"), 1))
    return both.crossJoin(F.broadcast(total)).agg(F.count("*").alias("keys"), under.alias("underestimates"), within.alias("within_bound"))


@query("cs_cells", CS_EVENTS)
def _(spark, d):
    return Linear.build(events(spark, d), "user_id", shape=CS).cells


@query("cs_point_estimate", s.estimates(CS_EVENTS, USERS, "user_id", signed=True))
def _(spark, d):
    e = events(spark, d)
    return Linear.build(e, "user_id", shape=CS).estimate(e, "user_id")


@query("cs_l2", f'SELECT sqrt(median(m))::DOUBLE AS l2 FROM (SELECT sum(v * v) AS m FROM ({CS_EVENTS}) GROUP BY "row")')
def _(spark, d):
    return Linear.build(events(spark, d), "user_id", shape=CS).l2()


@query("cs_merge_halves", s.cells("lineitem", "l_suppkey", signed=True))
def _(spark, d):
    lines = read(spark, d, "lineitem")
    a, b = (Linear.build(lines.where(f"l_linenumber % 2 = {i}"), "l_suppkey", shape=CS) for i in (0, 1))
    return a.merge(b).cells


@query(
    "cs_topk_wire",
    f"""SELECT user_id, estimate::BIGINT AS cnt, row_number() OVER (ORDER BY estimate::BIGINT DESC, user_id)::INTEGER AS rk
      FROM ({s.estimates(CS_EVENTS, USERS, "user_id", signed=True)}) WHERE estimate::BIGINT > 0 QUALIFY rk <= 20""",
)
def _(spark, d):
    e = events(spark, d)
    rows = Linear.build(e, "user_id", shape=CS).estimate(e, "user_id").select("user_id", F.col("estimate").cast("bigint").alias("cnt")).where("cnt > 0")
    return top_k(rows, 20, "cnt", "user_id")


_FOLD = s.cells("events", "user_id", 3, 4096)


@query(
    "fold_cm_profile",
    f"""SELECT 4 AS level, sum(n)::BIGINT AS total_entries, count(*) AS used_cells, count(*) FILTER (n > 1) AS collided_cells
      FROM (SELECT count(*) AS n FROM ({_FOLD}) WHERE v <> 0 GROUP BY "row", col & 255)""",
)
def _(spark, d):
    return Linear.build(events(spark, d), "user_id", shape=Shape(3, 4096)).fold_profile(4)


@query("fold_unfold_merge", _FOLD)
def _(spark, d):
    e, shape = events(spark, d), Shape(3, 4096)
    parts = [Linear.build(e.where(f"event_id % 3 = {i}"), "user_id", shape=shape).folded(level) for i, level in enumerate((4, 2, 0))]
    return unfold_merge(*parts)


@query("fold_cs_estimate", s.estimates(s.cells("events", "user_id", 3, 4096, signed=True), USERS, "user_id", 3, 4096, signed=True))
def _(spark, d):
    e, shape = events(spark, d), Shape(3, 4096, signed=True)
    folded = Linear.build(e, "user_id", shape=shape).folded(4)
    return Linear(unfold_merge(folded), shape).estimate(e, "user_id")


# --- sampling ---

_RATE = 0.25
_ADMIT = f"{s.uniform(repr('item'), 'event_id')} < {_RATE}"


@query("cm_sampled", s.estimates(s.cells("events", "user_id", where=_ADMIT), USERS, "user_id", factor="4.0::DOUBLE"))
def _(spark, d):
    e = events(spark, d)
    return sampling.sampled(e, "user_id", "event_id", _RATE).estimate(e, "user_id")


@query("sampled_per_row", s.cells("events", "user_id", w="4.0", where=f"{s.uniform(repr('row'), 'event_id', 'r')} < {_RATE}"))
def _(spark, d):
    return sampling.sampled_per_row(events(spark, d), "user_id", "event_id", _RATE).cells


@query("cs_sampled_per_row", s.cells("events", "user_id", w="4.0", signed=True, where=f"{s.uniform(repr('row'), 'event_id', 'r')} < {_RATE}"))
def _(spark, d):
    return sampling.sampled_per_row(events(spark, d), "user_id", "event_id", _RATE, CS).cells


@query("at_rows_mask", s.cells("events", "user_id", w="2.0", where="((event_id % 31 + 1) >> r) & 1 = 1"))
def _(spark, d):
    e = events(spark, d).withColumn("mask", F.col("event_id") % 31 + 1)
    return insert_at_rows(e, "user_id", "mask", Shape(), p=0.5).cells


@query("row_mask_of_sampler", f"SELECT event_id, sum(CASE WHEN {s.uniform(repr('row'), 'event_id', 'r')} < 0.5 THEN 1 << r ELSE 0 END)::BIGINT AS mask FROM events, range(5) t(r) GROUP BY 1")
def _(spark, d):
    return events(spark, d).select("event_id", sampling.row_mask(sampling.admitted_rows(F.col("event_id"), 5, 0.5)).alias("mask"))


_NITRO = f"""SELECT r::INTEGER AS "row", {s.col("r", "user_id", 2048)} AS col, count(*)::DOUBLE AS v FROM (
  SELECT user_id, ((row_number() OVER (ORDER BY event_id) - 1) % 5)::BIGINT AS r FROM events) GROUP BY ALL"""


@query("nitro_cm_fullrate", _NITRO)
def _(spark, d):
    return sampling.nitro(events(spark, d), "user_id", "event_id").cells


@query("nitro_estimate", s.estimates(_NITRO, USERS, "user_id", factor="5"))
def _(spark, d):
    e = events(spark, d)
    return sampling.nitro_estimate(sampling.nitro(e, "user_id", "event_id"), e, "user_id")


_NITRO_TENTH = f"""SELECT r::INTEGER AS "row", {s.col("r", "user_id", 2048)} AS col, count(*) * 10.0::DOUBLE AS v FROM (
  SELECT user_id, (p % 5)::BIGINT AS r FROM (SELECT user_id, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) WHERE {s.uniform(repr("nitro"), "p")} < 0.1) GROUP BY ALL"""


@query("nitro_sampled", s.estimates(_NITRO_TENTH, USERS, "user_id", factor="5"))
def _(spark, d):
    e = events(spark, d)
    return sampling.nitro_estimate(sampling.nitro(e, "user_id", "event_id", 0.1), e, "user_id")


@query("nitro_cs", s.estimates(_NITRO.replace("count(*)::DOUBLE", f"sum({s.sign('r', 'user_id')})::DOUBLE"), USERS, "user_id", signed=True, factor="5"))
def _(spark, d):
    e = events(spark, d)
    return sampling.nitro_estimate(sampling.nitro(e, "user_id", "event_id", shape=CS), e, "user_id")


@query("nitro_merge", _NITRO)
def _(spark, d):
    """Two sketches of equal rate: of the items at even and at odd positions of one order."""
    rows = sampling.positions(events(spark, d), "event_id")
    row = F.array(F.pmod("position", F.lit(5)).cast("int"))
    a, b = (Linear.build(rows.where(f"position % 2 = {i}"), "user_id", rows=row) for i in (0, 1))
    return a.merge(b).cells


# --- deltas ---

_EARLY = s.cells("events", "user_id", where="event_id % 4 <> 0")
_EARLY_CS = s.cells("events", "user_id", signed=True, where="event_id % 4 <> 0")


def _diff(now: str, before: str, threshold: str) -> str:
    return f"""SELECT a."row", a.col, a.v - coalesce(b.v, 0) AS d FROM ({now}) a LEFT JOIN ({before}) b USING ("row", col)
      WHERE a.v <> coalesce(b.v, 0) AND abs(a.v - coalesce(b.v, 0)) >= {threshold}"""


def _snapshots(spark, d, shape):
    e = events(spark, d)
    return Linear.build(e.where("event_id % 4 <> 0"), "user_id", shape=shape), Linear.build(e, "user_id", shape=shape)


@query("delta_cm", _diff(CM_EVENTS, _EARLY, "5"))
def _(spark, d):
    before, now = _snapshots(spark, d, Shape())
    return now.delta(before, 5)


@query("delta_cs", _diff(CS_EVENTS, _EARLY_CS, "3"))
def _(spark, d):
    before, now = _snapshots(spark, d, CS)
    return now.delta(before, 3)


@query("delta_cs_per_cell", _diff(CS_EVENTS, _EARLY_CS, "(CASE WHEN a.\"row\" < 3 THEN 2.0 + a.col % 5 ELSE 0 END)"))
def _(spark, d):
    before, now = _snapshots(spark, d, CS)
    cells = spark.range(3 * 2048).select((F.col("id") / 2048).cast("int").alias("row"), (F.col("id") % 2048).cast("int").alias("col"))
    return now.delta_by_cell(before, cells.withColumn("t", F.lit(2.0) + F.col("col") % 5))


@query("delta_apply_roundtrip", CM_EVENTS)
def _(spark, d):
    before, now = _snapshots(spark, d, Shape())
    return before.apply(now.delta(before)).cells


@query("delta_vs_empty", CM_EVENTS.replace("AS v", "AS d"))
def _(spark, d):
    return Linear.build(events(spark, d), "user_id").delta()


_OCTO = f'SELECT worker, "row", col, v::BIGINT AS n, (v::BIGINT // 5) + (v::BIGINT % 5 > 0)::BIGINT AS messages, v::BIGINT - v::BIGINT % 5 AS emitted, v::BIGINT % 5 AS residual FROM ({s.cells("(SELECT *, (event_id % 4)::INTEGER AS worker FROM events)", "user_id", by="worker")})'


def _octo(spark, d):
    e = events(spark, d).withColumn("worker", (F.col("event_id") % 4).cast("int"))
    return deltas.emissions(e, "user_id", 5, "worker")


@query("octo_messages", _OCTO)
def _(spark, d):
    return _octo(spark, d)


@query("octo_residuals", f"SELECT worker, sum(messages)::BIGINT AS messages, sum(residual)::BIGINT AS residual, max(residual) AS most FROM ({_OCTO}) GROUP BY 1")
def _(spark, d):
    return _octo(spark, d).groupBy("worker").agg(F.sum("messages").alias("messages"), F.sum("residual").alias("residual"), F.max("residual").alias("most"))


@query("gos_crossings", f'SELECT "row", col, v::BIGINT // 8 AS crossings FROM ({CM_EVENTS}) WHERE v >= 8')
def _(spark, d):
    out = deltas.emissions(events(spark, d), "user_id", 8).where("emitted > 0")
    return out.select("row", "col", (F.col("emitted") / 8).cast("bigint").alias("crossings"))


@query("gos_telescoping", CM_EVENTS)
def _(spark, d):
    out = deltas.emissions(events(spark, d), "user_id", 8)
    return out.select("row", "col", (F.col("emitted") + F.col("residual")).cast("double").alias("v"))


# --- three counters a cell; keys beside cells ---


def _tally(ask: str, squares: bool = False) -> str:
    w = {"frequency": "1", "sum": "l_quantity", "sum2": "l_quantity * l_quantity" if squares else "l_quantity"}[ask]
    return s.estimates(s.cells("lineitem", "l_orderkey", w=w), "SELECT l_orderkey FROM lineitem", "l_orderkey")


@query("cm_query_sum", _tally("sum"))
def _(spark, d):
    lines = read(spark, d, "lineitem")
    return Tally.build(lines, "l_orderkey", "l_quantity").query(lines, "l_orderkey", "sum")


@query("cm_query_sum2", _tally("sum2"))
def _(spark, d):
    lines = read(spark, d, "lineitem")
    return Tally.build(lines, "l_orderkey", "l_quantity").query(lines, "l_orderkey", "sum2")


@query("cm_query_squares", _tally("sum2", True))
def _(spark, d):
    lines = read(spark, d, "lineitem")
    a, b = (Tally.build(lines.where(f"l_linenumber % 2 = {i}"), "l_orderkey", "l_quantity", squares=True) for i in (0, 1))
    return a.merge(b).query(lines, "l_orderkey", "sum2")


def _top(cells: str, table: str, key: str, k: int, signed: bool) -> str:
    found = s.estimates(cells, f"SELECT {key} AS k FROM {table}", "k", signed=signed)
    return f"SELECT k::VARCHAR AS key, estimate::BIGINT AS cnt, row_number() OVER (ORDER BY estimate::BIGINT DESC, k::VARCHAR)::INTEGER AS rk FROM ({found}) WHERE estimate::BIGINT > 0 QUALIFY rk <= {k}"


_SKEW_LINES = "(SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN -l_linenumber::BIGINT ELSE l_partkey END AS k FROM lineitem)"
_CS_TOP = _top(s.cells(_SKEW_LINES, "k", signed=True), _SKEW_LINES, "k", 5, True)


@query("cs_tracked_topk", _CS_TOP)
def _(spark, d):
    """The 100 keys that Space-Saving keeps hold the heaviest by Count-Sketch estimate."""
    return Tracked.build(_skewed(spark, d), "k").top_k(5)


@query("cs_tracked_merge", _CS_TOP)
def _(spark, d):
    rows = _skewed(spark, d)
    a, b = (Tracked.build(rows.where(f"l_linenumber % 2 = {i}"), "k") for i in (0, 1))
    return a.merge(b).top_k(5)


@query("cs_tracked_delta", _CS_TOP)
def _(spark, d):
    """A receiver that applies what changed estimates the sender's keys from its merged cells."""
    rows = _skewed(spark, d)
    before, now = Tracked.build(rows.where("l_orderkey % 4 <> 0"), "k"), Tracked.build(rows, "k")
    return before.apply(now.delta(before)).top_k(5)


@query("cm_tracked_delta", _top(s.cells(_SKEW_LINES, "k"), _SKEW_LINES, "k", 5, False))
def _(spark, d):
    rows = _skewed(spark, d)
    before, now = (Tracked.build(r, "k", shape=Shape()) for r in (rows.where("l_orderkey % 4 <> 0"), rows))
    return before.apply(now.delta(before)).top_k(5)


@query("cm_delta_l1", f'SELECT "row", sum(d) AS d FROM ({_diff(CM_EVENTS, _EARLY, "0")}) GROUP BY 1')
def _(spark, d):
    """Row masses of a delta are sent in full, whatever its cells' threshold."""
    e = events(spark, d)
    before, now = (Tracked.build(r, "user_id", shape=Shape()) for r in (e.where("event_id % 4 <> 0"), e))
    return now.delta(before, 1000).l1


@query("cs_delta_apply", CS_EVENTS)
def _(spark, d):
    before, now = _snapshots(spark, d, CS)
    return before.apply(now.delta(before)).cells


@query("fold_unfold_to", f'SELECT "row", col & 1023 AS fold_col, col, v FROM ({_FOLD})')
def _(spark, d):
    return Linear.build(events(spark, d), "user_id", shape=Shape(3, 4096)).unfolded(4, 2)


# --- exact truth, several sketches, heavy hitters ---


@query("heavy_hitters_exact", "SELECT user_id, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, user_id)::INTEGER AS rk FROM events GROUP BY 1 QUALIFY rk <= 10")
def _(spark, d):
    return heavy.exact_top_k(events(spark, d), "user_id", 10)


@query("l2_exact", "SELECT sqrt(sum(n * n)) AS l2 FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def _(spark, d):
    return events(spark, d).groupBy("user_id").count().agg(F.sqrt(F.sum(F.col("count") * F.col("count"))).alias("l2"))


@query("distinct_exact", "SELECT count(DISTINCT l_orderkey) AS n FROM lineitem")
def _(spark, d):
    return read(spark, d, "lineitem").agg(F.countDistinct("l_orderkey").alias("n"))


@query(
    "hash_layer_vector",
    f"""SELECT 'cm' AS sketch, user_id::VARCHAR AS key, estimate AS value, NULL::VARCHAR AS error FROM ({s.estimates(CM_EVENTS, USERS, "user_id")})
      UNION ALL SELECT 'cs', user_id::VARCHAR, estimate, NULL FROM ({s.estimates(CS_EVENTS, USERS, "user_id", signed=True)})
      UNION ALL SELECT DISTINCT 'hll', user_id::VARCHAR, NULL::DOUBLE, 'no frequency' FROM events""",
)
def _(spark, d):
    e = events(spark, d)
    return layer.query(layer.build(e, "user_id", {"cm": Shape(), "cs": CS, "hll": "ertl"}), e, "user_id", "frequency")


@query("hash_layer_registers", s.registers("events", "user_id"))
def _(spark, d):
    return layer.build(events(spark, d), "user_id", {"cm": Shape(), "hll": "ertl"})["hll"].registers


_SIX = ["cells", "signed", "registers", "buckets", "ranks", "owners"]


@query("hash_layer_six", "SELECT unnest(['cells', 'signed', 'registers', 'buckets', 'ranks', 'owners']) AS sketch, true AS within")
def _(spark, d):
    """Six kinds from one scan, sums, maxima and states that depend on the order: cells as built alone, a median of rank within 3 %, and no weight lost."""
    rows = read(spark, d, "lineitem")
    kinds = dict(zip(_SIX, (Shape(3, 512), Shape(3, 512, signed=True), "ertl", Mapping(0.01), layer.Ranks(), layer.Owners(3, 512)), strict=True))
    built = layer.build(rows, "l_partkey", kinds)
    same = lambda a, b: a.exceptAll(b).unionByName(b.exceptAll(a)).agg((F.count("*") == 0).alias("within"))
    n = rows.agg(F.count("l_partkey").alias("n"))
    median = built["ranks"].quantiles([0.5]).select(F.col("value").alias("m"))
    share = rows.crossJoin(F.broadcast(median)).agg((F.avg((F.col("l_partkey") <= F.col("m")).cast("int")) - 0.5).alias("off"))
    checks = {
        "cells": same(built["cells"].cells, Linear.build(rows, "l_partkey", shape=Shape(3, 512)).cells),
        "signed": same(built["signed"].cells, Linear.build(rows, "l_partkey", shape=Shape(3, 512, signed=True)).cells),
        "registers": same(built["registers"].registers, HLL.build(rows, "l_partkey").registers),
        "buckets": same(built["buckets"].buckets, DDSketch.build(rows, "l_partkey").buckets),
        "ranks": share.crossJoin(built["ranks"].counts.withColumnRenamed("n", "seen")).crossJoin(n).select(((F.abs("off") <= 0.03) & (F.col("seen") == F.col("n"))).alias("within")),
        "owners": built["owners"].partial(F.lit(True)).crossJoin(n).select((F.col("estimate") == F.col("n")).alias("within")),
    }
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("sketch"), "within") for name, df in checks.items()))


@query("any_sketch_merge", s.cells("events", "user_id", signed=True))
def _(spark, d):
    """Sketches of one type merge, whatever it is."""
    e = events(spark, d)
    a, b = (layer.build(e.where(f"event_id % 2 = {i}"), "user_id", {"x": CS, "y": "ertl"}) for i in (0, 1))
    return layer.merge(a["x"], b["x"]).cells


# --- hashes ---

# Positive numbers: the exponent from the logarithm, the rest is a whole number of 2^-52.
_EXPONENT = "floor(log2(o_totalprice))::INTEGER"


@query("float_bits", f"SELECT o_orderkey, ((1023 + {_EXPONENT})::HUGEINT * 4503599627370496 + ((o_totalprice / pow(2.0::DOUBLE, {_EXPONENT}) - 1) * 4503599627370496)::HUGEINT)::VARCHAR AS bits FROM orders")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", hashing.float_bits()(F.col("o_totalprice").cast("double")).alias("bits"))


_WORD = s.word("user_id")


@query(
    "hash_slices",
    f"SELECT DISTINCT user_id, (({_WORD} >> 22) & 2047)::INTEGER AS col, (CASE WHEN ({_WORD} >> 61) & 1 = 1 THEN 1 ELSE -1 END)::INTEGER AS sign FROM events",
)
def _(spark, d):
    """The third row's column and sign of a 64-bit hash."""
    h = hashing.word_of(F.col("user_id"), "md5")
    return events(spark, d).select("user_id", hashing.derive_index(h, 2, 2048).alias("col"), hashing.derive_sign(h, 2).alias("sign")).distinct()


_MASK = "18446744073709551616::UHUGEINT"


def _mixed(x: str) -> str:
    """A splitmix64 step in 128-bit numbers."""
    x = f"(({x})::UHUGEINT + {hashing.GOLDEN}::UHUGEINT) % {_MASK}"
    for shift, factor in ((30, hashing.MIX_A), (27, hashing.MIX_B)):
        x = f"(xor(({x})::UBIGINT, ({x})::UBIGINT >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {_MASK}"
    return f"xor(({x})::UBIGINT, ({x})::UBIGINT >> 31)"


@query("hash_matrix", f"SELECT DISTINCT user_id, user_id AS lower, {_mixed(f'xor(user_id::UBIGINT, {hashing.GOLDEN}::UBIGINT)')}::UBIGINT::VARCHAR AS upper FROM events")
def _(spark, d):
    """A 128-bit hash for 8 rows of 4,096 columns, from one 64-bit word."""
    words = events(spark, d).select("user_id").distinct().withColumn("w", hashing.matrix_hash(8, 4096)(F.col("user_id")))
    unsigned = F.pmod(F.col("w")[1].cast("decimal(21,0)") + F.lit("18446744073709551616").cast("decimal(21,0)"), F.lit("18446744073709551616").cast("decimal(21,0)"))
    return words.select("user_id", F.col("w")[0].alias("lower"), unsigned.cast("decimal(20,0)").cast("string").alias("upper"))


@query("hash_xxh3", "SELECT count(DISTINCT user_id) AS keys, count(DISTINCT user_id) AS hashes, count(DISTINCT user_id) AS seeded, count(DISTINCT user_id) AS wide, 0::BIGINT AS same FROM events")
def _(spark, d):
    """XXH3 of each key under two seeds and at 128 bits: keys stay apart, seeds differ."""
    key = F.col("k")
    rows = events(spark, d).select(F.col("user_id").cast("string").alias("k")).distinct()
    rows = rows.select("k", hashing.hash64()(key).alias("a"), hashing.hash_it(5)(key).alias("b"), hashing.hash128_it(5)(key).alias("c"))
    return rows.agg(
        F.count("*").alias("keys"), F.countDistinct("a").alias("hashes"), F.countDistinct("b").alias("seeded"), F.countDistinct("c").alias("wide"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("same")
    )


@query("hash_threshold", "SELECT true AS whole, true AS share FROM (SELECT 1)")
def _(spark, d):
    """A key is kept with all its rows or none of them, about a quarter of the keys."""
    lines = read(spark, d, "lineitem")
    kept = sampling.hash_threshold(lines, "l_orderkey", 0.25).groupBy("l_orderkey").agg(F.count("*").alias("kept"))
    both = lines.groupBy("l_orderkey").agg(F.count("*").alias("n")).join(kept, "l_orderkey", "left")
    whole = F.bool_and(F.col("kept").isNull() | (F.col("kept") == F.col("n")))
    return both.agg(whole.alias("whole"), (F.abs(F.count("kept") / F.count("*") - 0.25) < 0.05).alias("share"))


@query("packets", "SELECT event_id AS seq, user_id::VARCHAR AS key FROM events")
def _(spark, d):
    return packets(events(spark, d), "user_id", "event_id")


@query("snapshot", CM_EVENTS)
def _(spark, d):
    """Written to Parquet and read again."""
    from ..streaming.stateful import scratch

    path = scratch(spark, "snapshot")
    save(Linear.build(events(spark, d), "user_id"), path)
    return load(spark, path).cells


# Every third order's lines by line number, few and frequent; the others by part.
_SKEWED = "CASE WHEN l_orderkey % 3 = 0 THEN -l_linenumber::BIGINT ELSE l_partkey END"


def _skewed(spark, d):
    return read(spark, d, "lineitem").withColumn("k", F.expr(_SKEWED.replace("::BIGINT", "")).cast("bigint"))


@query("space_saving", f"SELECT n AS key_count, n AS tracked, true AS within, true AS bounded FROM (SELECT count(*) AS n FROM (SELECT {_SKEWED} AS k FROM lineitem GROUP BY 1 HAVING count(*) > (SELECT count(*) FROM lineitem) / 50))")
def _(spark, d):
    """50 of over 1,000 keys: counts and errors enclose the truth, and all keys above a 50th of the rows are tracked."""
    rows, k = _skewed(spark, d), 50
    true = rows.groupBy(F.col("k").cast("string").alias("key")).agg(F.count("*").alias("n"))
    total = rows.agg((F.count("*") / k).alias("heavy"))
    both = true.join(heavy.space_saving(rows, "k", k), "key", "left").crossJoin(F.broadcast(total))
    is_heavy, tracked = F.col("n") > F.col("heavy"), F.col("cnt").isNotNull()
    right = ~tracked | ((F.col("cnt") - F.col("err") <= F.col("n")) & (F.col("n") <= F.col("cnt")))
    return both.agg(F.count(F.when(is_heavy, 1)).alias("key_count"), F.count(F.when(is_heavy & tracked, 1)).alias("tracked"), F.bool_and(right).alias("within"), (F.count(F.when(tracked, 1)) <= k).alias("bounded"))


@query("space_saving_grouped", "SELECT l_returnflag, true AS within, true AS bounded FROM (SELECT DISTINCT l_returnflag FROM lineitem)")
def _(spark, d):
    rows, k = _skewed(spark, d), 50
    true = rows.groupBy("l_returnflag", F.col("k").cast("string").alias("key")).agg(F.count("*").alias("n"))
    both = heavy.space_saving(rows, "k", k, by="l_returnflag").join(true, ["l_returnflag", "key"])
    right = (F.col("cnt") - F.col("err") <= F.col("n")) & (F.col("n") <= F.col("cnt"))
    return both.groupBy("l_returnflag").agg(F.bool_and(right).alias("within"), (F.count("*") <= k).alias("bounded"))


@query("space_saving_all_tracked", "SELECT user_id::VARCHAR AS key, count(*)::DOUBLE AS cnt, 0.0::DOUBLE AS err FROM events GROUP BY 1 QUALIFY row_number() OVER (ORDER BY count(*) DESC, key) <= 4000")
def _(spark, d):
    """Users in parts that tables of 4,000 hold whole; of all the 4,000 busiest."""
    return top_k(heavy.space_saving_all(events(spark, d), "user_id", 4000), 4000, "cnt", "key").drop("rk")


_HEAVY = f"SELECT {_SKEWED} AS k, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > (SELECT count(*) FROM lineitem) / 100"


def _heavy_errors(table, spark, d):
    """``(k, n, within)`` of keys above 1 % of the rows: whether the estimate is within 10 %."""
    rows = _skewed(spark, d)
    true = rows.groupBy("k").agg(F.count("*").alias("n")).crossJoin(F.broadcast(rows.agg((F.count("*") / 100).alias("t")))).where("n > t")
    both = true.join(table.estimate().withColumn("k", F.col("key").cast("bigint")), "k", "left")
    return both.select("k", "n", (F.abs(F.coalesce("estimate", F.lit(0)) - F.col("n")) <= 0.1 * F.col("n")).alias("within"))


@query("coco", f"SELECT k, n, true AS within FROM ({_HEAVY})")
def _(spark, d):
    """Some thousand keys in 5 x 256 buckets: owners change, and heavy keys stay."""
    return _heavy_errors(Coco.build(_skewed(spark, d), "k", 5, 256), spark, d)


@query("coco_merge", f"SELECT k, n, true AS within FROM ({_HEAVY})")
def _(spark, d):
    rows = _skewed(spark, d)
    a, b = (Coco.build(rows.where(f"l_linenumber % 2 = {i}"), "k", 5, 256) for i in (0, 1))
    return _heavy_errors(a.merge(b), spark, d)


@query("coco_mass", "SELECT count(*)::BIGINT AS estimate FROM lineitem")
def _(spark, d):
    rows = _skewed(spark, d)
    a, b = (Coco.build(rows.where(f"l_linenumber % 2 = {i}"), "k", 3, 64) for i in (0, 1))
    return a.merge(b).partial(F.lit(True))


@query("coco_partial_key", "SELECT count(*)::BIGINT AS estimate FROM events WHERE event_type LIKE '%a%'")
def _(spark, d):
    """Each of five keys finds a bucket of its own: partial keys are exact."""
    return Coco.build(events(spark, d), "event_type", 3, 256).partial(F.col("key").contains("a"))


@query("coco_partial_evicting", "SELECT true AS within")
def _(spark, d):
    """Negative keys among all, by their sign: within 10 % though most keys own nothing."""
    rows = _skewed(spark, d)
    true = rows.agg(F.count(F.when(F.col("k") < 0, 1)).alias("n"))
    found = Coco.build(rows, "k", 5, 256).partial(F.col("key").startswith("-"))
    return found.crossJoin(true).select((F.abs(F.col("estimate") - F.col("n")) <= 0.1 * F.col("n")).alias("within"))


_ENDS = "SELECT event_type AS part, true AS within FROM events UNION SELECT user_id::VARCHAR, true FROM events"


@query("coco_partial_function", _ENDS)
def _(spark, d):
    """All types and all users as partial keys of ``type@user``, matched by a function: sums within 1 % of all events."""
    e = events(spark, d).withColumn("full", F.concat_ws("@", "event_type", "user_id"))
    sides = e.select(F.explode(F.array("event_type", F.col("user_id").cast("string"))).alias("part"))
    true = sides.groupBy("part").agg(F.count("*").alias("n"))
    is_side = lambda full, part: pd.Series([p in f.split("@") for f, p in zip(full, part, strict=True)], dtype="boolean")
    found = Coco.build(e, "full", 4, 4096).partials(true, "part", is_side, lambda key: F.split(key, "@"))
    total = e.agg(F.count("*").alias("t"))
    return found.join(true, "part").crossJoin(F.broadcast(total)).select("part", (F.abs(F.col("estimate") - F.col("n")) <= 0.01 * F.col("t") + 1).alias("within"))


# Votes of each range and bucket item by item, then the ranges' outcomes in order; what a contest sends to the light part on the way.
_STAYS = "(v.flow = e.flow OR v.neg + 1 < 8 * v.pos)"
_LOST = "greatest(1, 8 * m.pos - m.neg)"


def _elastic(source: str, buckets: int, every: int) -> str:
    return f"""e AS (SELECT *, row_number() OVER (PARTITION BY span, bucket ORDER BY event_id, flow) AS i FROM (
      SELECT event_id, floor(event_id / {every}.0)::BIGINT AS span, ({s.half("user_id", 1)} % {buckets})::INTEGER AS bucket, user_id::VARCHAR AS flow FROM {source})),
    v AS (SELECT span, bucket, i, flow, 1::BIGINT AS pos, 0::BIGINT AS neg, false AS mixed, NULL::VARCHAR AS lost, 0::BIGINT AS n FROM e WHERE i = 1
      UNION ALL SELECT e.span, e.bucket, e.i, CASE WHEN {_STAYS} THEN v.flow ELSE e.flow END,
        CASE WHEN v.flow = e.flow THEN v.pos + 1 WHEN {_STAYS} THEN v.pos ELSE 1 END, CASE WHEN v.flow = e.flow THEN v.neg WHEN {_STAYS} THEN v.neg + 1 ELSE 1 END,
        v.mixed OR NOT {_STAYS}, CASE WHEN v.flow = e.flow THEN NULL WHEN {_STAYS} THEN e.flow ELSE v.flow END, CASE WHEN v.flow = e.flow THEN 0 WHEN {_STAYS} THEN 1 ELSE v.pos END
      FROM v JOIN e ON e.span = v.span AND e.bucket = v.bucket AND e.i = v.i + 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY span) AS k FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY span, bucket ORDER BY i DESC) = 1)),
    m AS (SELECT bucket, k, flow, pos, neg, mixed, NULL::VARCHAR AS f1, 0::BIGINT AS n1, NULL::VARCHAR AS f2, 0::BIGINT AS n2 FROM o WHERE k = 1
      UNION ALL SELECT o.bucket, o.k, CASE WHEN m.flow = o.flow OR o.pos < {_LOST} THEN m.flow ELSE o.flow END,
        CASE WHEN m.flow = o.flow THEN m.pos + o.pos WHEN o.pos < {_LOST} THEN m.pos ELSE o.pos - {_LOST} + 1 END,
        CASE WHEN m.flow = o.flow THEN m.neg + o.neg WHEN o.pos < {_LOST} THEN m.neg + o.pos ELSE 1 END,
        m.flow <> o.flow OR m.mixed OR o.mixed,
        CASE WHEN m.flow <> o.flow THEN o.flow END, CASE WHEN m.flow = o.flow THEN 0 WHEN o.pos < {_LOST} THEN o.pos ELSE {_LOST} - 1 END,
        CASE WHEN m.flow <> o.flow AND o.pos >= {_LOST} THEN m.flow END, CASE WHEN m.flow <> o.flow AND o.pos >= {_LOST} THEN m.pos ELSE 0 END
      FROM m JOIN o ON o.bucket = m.bucket AND o.k = m.k + 1),
    light AS (SELECT lost AS flow, n FROM v WHERE lost IS NOT NULL UNION ALL SELECT f1, n1 FROM m WHERE f1 IS NOT NULL UNION ALL SELECT f2, n2 FROM m WHERE f2 IS NOT NULL),
    heavy AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY k DESC) = 1)"""


@query("elastic_heavy", f"WITH RECURSIVE {_elastic('events', 16, 2500)} SELECT bucket, flow, pos AS vote_pos, neg AS vote_neg, mixed FROM heavy")
def _(spark, d):
    return heavy.elastic(events(spark, d), "user_id", "event_id", 16, 2500).heavy


@query(
    "elastic",
    f"""WITH RECURSIVE {_elastic("events", 16, 2500)}
    SELECT user_id, (CASE WHEN h.flow IS NULL THEN estimate ELSE h.pos + CASE WHEN h.mixed THEN estimate ELSE 0 END END)::BIGINT AS estimate
    FROM ({s.estimates(s.cells("light", "flow", w="n"), "SELECT user_id::VARCHAR AS user_id FROM events", "user_id")}) LEFT JOIN heavy h ON h.flow = user_id""",
)
def _(spark, d):
    e = events(spark, d)
    return heavy.elastic_query(heavy.elastic(e, "user_id", "event_id", 16, 2500), e, "user_id")


@query("elastic_never_under", "SELECT count(DISTINCT user_id) AS keys, 0::BIGINT AS under FROM events")
def _(spark, d):
    e = events(spark, d)
    true = e.groupBy(F.col("user_id").cast("string").alias("user_id")).agg(F.count("*").alias("n"))
    both = heavy.elastic_query(heavy.elastic(e, "user_id", "event_id", 8, 1000), e, "user_id").join(true, "user_id")
    return both.agg(F.count("*").alias("keys"), F.count(F.when(F.col("estimate") < F.col("n"), 1)).alias("under"))


@query("elastic_heavy_only", "SELECT event_type, count(*) AS estimate FROM events GROUP BY 1")
def _(spark, d):
    # Five keys in 4096 buckets own one each: votes are exact.
    e = events(spark, d)
    return heavy.elastic_query(heavy.elastic(e, "event_type", "event_id", 4096), e, "event_type")


@query("elastic_merge", s.cells("events", "user_id"))
def _(spark, d):
    """Owners change in 16 buckets; flushed, all of both halves is in the light part."""
    e = events(spark, d)
    a, b = (heavy.elastic(e.where(f"event_id % 2 = {i}"), "user_id", "event_id", 16, 2500) for i in (0, 1))
    return heavy.elastic_merge(a, b).cells


@query("approx_top_k_builtin", "SELECT count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC)::INTEGER AS rk FROM events GROUP BY user_id QUALIFY rk <= 10")
def _(spark, d):
    """The built-in cousin, over parts of the users: with fewer of them in a part than it tracks (10,000) its counts are exact."""
    top = dealt(events(spark, d), "user_id", 10_000).groupBy("_deal").agg(F.expr("approx_top_k(user_id, 10)").alias("top"))
    rows = top.select(F.explode("top").alias("x")).select(F.col("x.item").alias("user_id"), F.col("x.count").alias("cnt"))
    return top_k(rows, 10, "cnt", "user_id").select("cnt", "rk")
