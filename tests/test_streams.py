"""Crossings of whole blocks, and streams whose windows are sent piece by piece and closed by timers."""

import datetime
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellmesh.operators import frames as frames_of
from cellmesh.operators import heavy, hydra, kll, layer, windows, workers
from cellmesh.operators.crossing import Blocks, Reach, applied
from cellmesh.operators.ddsketch import Mapping
from cellmesh.operators.frames import Mismatch, UnsupportedQuery
from cellmesh.operators.hll import HLL
from cellmesh.operators.linear import Linear, Shape
from cellmesh.sources import tables
from cellmesh.streaming import closing, frames, sketches, stateful


def one_by_one(w, tau, held, signed):
    sent = []
    for i, (x, t) in enumerate(zip(w, tau, strict=True)):
        held += x
        if (abs(held) if signed else held) >= t:
            sent.append((i, held))
            held = 0.0
    return sent, held


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(-5, 6), st.integers(1, 15)), max_size=30), min_size=1, max_size=5), st.booleans(), st.booleans(), st.integers(0, 14), st.booleans())
def test_blocks(parts, signed, positive, held, fixed):
    start = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    w = np.array([abs(x) if positive else x for p in parts for x, _ in p], float)
    tau = np.array([7 if fixed else t for p in parts for _, t in p], float)
    before = np.array([held * (-1) ** (k if signed else 0) for k in range(len(parts))], float)
    blocks = Blocks(w, tau, start, signed)
    places, sent, left = blocks.run(before)
    expected = []
    for k in range(len(parts)):
        part = slice(start[k], start[k + 1])
        found, rest = one_by_one(w[part], tau[part], before[k], signed)
        expected += [(start[k] + i, d) for i, d in found]
        assert left[k] == rest == applied(blocks.function(k), before[k])
    assert list(zip(places.tolist(), sent.tolist(), strict=True)) == expected


def test_functions_of_blocks_are_small():
    """Once every value crosses, a table ends: unit updates under a threshold of 8 need 8 entries."""
    n = 5000
    assert len(Blocks(np.ones(n), np.full(n, 8.0), np.array([0, n]), False).function(0)[0]) == 8
    signs = np.random.default_rng(1).choice([-1.0, 1.0], n)
    low, *_, high, _, _, _ = Blocks(signs, np.full(n, 8.0), np.array([0, n]), True).function(0)
    assert len(low) + len(high) <= 18


def test_reach():
    values = np.array([1.0, 5.0, 2.0, 7.0, 0.0])
    r = Reach(values, 5)
    first = lambda a, b, x: int(r.first(np.array([a]), np.array([b]), np.array([x]))[0])
    assert [first(0, 5, 5.0), first(2, 5, 5.0), first(4, 5, 1.0), first(0, 1, 5.0), first(3, 3, 0.0)] == [1, 3, 5, 1, 3]


@pytest.mark.parametrize(("span", "signed"), [(10_000, True), (40, True), (40, False), (1, False)])
def test_spans_of_a_cell(spark, monkeypatch, span, signed):
    """However the ticks are cut, and however Arrow cuts the batches, messages are those of one update after the other."""
    monkeypatch.setattr(workers, "SPAN", span)
    r = random.Random(4)
    rows = [(i, r.choice([None, 0]) if i % 50 == 0 else i % 3, r.choice("aab"), r.randint(-1, 4) or None) for i in range(300)]
    df = spark.createDataFrame(rows, "i bigint, g int, k string, w int").withColumn("t", F.lit(6.0) + F.col("i") % 5)
    shape = Shape(2, 4, signed=signed)
    cells = Linear.build(df, "k", shape=shape).cells  # places of keys
    assert cells.count() > 2
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = [(x.g, x.row, x.col, x.at, x.d, x.flush) for x in workers.crossings(df, "k", "i", "t", shape, "w", "g").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    from cellmesh.operators.linear import addressed

    placed = addressed(df.where("w is not null"), "k", shape).orderBy("i").collect()
    streams = defaultdict(list)
    for x in placed:
        streams[x.g, x.row, x.col].append((x.i, x.sign * x.w, x.t))
    expected = []
    for cell, items in streams.items():
        sent, held = one_by_one([w for _, w, _ in items], [t for *_, t in items], 0.0, signed)
        expected += [(*cell, items[i][0], d, False) for i, d in sent] + [(*cell, None, held, True)]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_crossings_of_timestamps(spark):
    df = spark.range(100).select(F.lit("k").alias("k"), F.timestamp_seconds("id").alias("ts"))
    sent = workers.crossings(df, "k", "ts", 30, Shape(1, 4)).orderBy("at").collect()
    assert [(x.at, x.d) for x in sent if not x.flush] == [(29_000_000, 30.0), (59_000_000, 30.0), (89_000_000, 30.0)]
    assert [x.d for x in sent if x.flush] == [10.0]


# --- streams ---

DAY = datetime.datetime(2024, 1, 1)


def folder(spark, path, files):
    """A table of files, written one after the other: rows of (hour, key, kind)."""
    for rows in files:
        made = spark.createDataFrame([(DAY + datetime.timedelta(hours=h), k, g) for h, k, g in rows], "ts timestamp, k string, g string")
        made.coalesce(1).write.mode("append").parquet(f"{path}/t.parquet")
    return frames.watermarked(tables.stream(spark, str(path), "t", 1), "ts", "0 seconds")


FILES = [
    [(1, "a", "x"), (2, "a", "x"), (3, "b", None)],
    [(20, "a", "x"), (21, None, "x"), (23, "c", "y"), (26, "a", "x")],
    [(25, "a", "x"), (30, "b", "x"), (49, "a", "x")],
    [(2, "late", "x"), (26, "late", "x"), (50, "a", "y")],
]


def test_window_deltas(spark, tmp_path):
    shape = Shape(1, 8)
    sent = stateful.drained(closing.window_deltas(folder(spark, tmp_path, FILES), "ts", "k", "1 day", "g", shape)).collect()
    day = lambda x: (x.window_start - DAY).days
    closed = {(x.partition_key, day(x)): x.d for x in sent if x.is_close}
    # The third day stays open; items of closed days are dropped, and an item without a key counts nowhere.
    assert closed == {("x", 0): 3.0, (None, 0): 1.0, ("y", 0): 1.0, ("x", 1): 3.0}
    assert all(x.row is None and x.col is None for x in sent if x.is_close)
    total = defaultdict(float)
    for x in sent:
        if not x.is_close:
            total[x.partition_key, day(x), x.col] += x.d
    kept = [(g, h // 24, k) for f in FILES[:3] for h, k, g in f if k] + [("y", 2, "a")]
    keys = spark.createDataFrame(kept, "g string, d int, k string")
    exact = {(r.g, r.d, r.col): r.v for r in Linear.build(keys, "k", by=["g", "d"], shape=shape).cells.collect()}
    assert total == exact
    seqs = defaultdict(set)
    for x in sent:
        if not x.is_close:
            seqs[x.partition_key, day(x)].add(x.seq)
    assert seqs["x", 0] == {0, 1} and seqs["x", 1] == {0, 1} and seqs["x", 2] == {0}


def test_small_changes_wait_for_the_end(spark, tmp_path):
    sent = stateful.drained(closing.window_deltas(folder(spark, tmp_path, FILES), "ts", "k", "1 day", None, Shape(1, 8), threshold=3)).collect()
    first = [x for x in sent if (x.window_start - DAY).days == 0 and not x.is_close]
    assert {x.partition_key for x in sent} == {"all"} and sorted(x.d for x in first) == [1.0, 1.0, 3.0]
    cells, closed = closing.replayed(spark.createDataFrame(sent, closing.timed(spark.createDataFrame([], closing.MESSAGE)).schema))
    assert {r["items"] for r in closed.collect()} == {5, 3} and cells.agg(F.sum("v")).first()[0] == 8.0


def test_windows_flush_what_they_hold(spark, tmp_path):
    shape = Shape(2, 4)
    rows = [[(h + 1, "ab"[h % 3 == 0], "x") for h in range(a, b)] for a, b in ((0, 7), (7, 20), (20, 23), (23, 60))]
    sent = stateful.drained(closing.window_thresholds(folder(spark, tmp_path, rows), "ts", "k", "1 day", 5, None, shape), whole=True).collect()
    first = [x for x in sent if (x.window_start - DAY).days == 0]
    total = defaultdict(float)
    for x in first:
        total[x.row, x.col] += x.d
        assert x.d == 5 if not x.flush else x.d < 5
    keys = spark.createDataFrame([(k,) for f in rows for h, k, _ in f if h < 24], "k string")
    assert total == {(r.row, r.col): r.v for r in Linear.build(keys, "k", shape=shape).cells.collect()}
    assert not [x for x in sent if (x.window_start - DAY).days == 2 and x.flush]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 3), st.sampled_from([1.0, 1.0, -1.0, 2.5])), min_size=1, max_size=80), st.integers(1, 6), st.integers(1, 9))
def test_runs_keep_the_order_of_a_cell(updates, runs, spread):
    of = lambda key, cols, w: [(key, int(c), float(x)) for c, x in zip(cols, w, strict=True)]
    by_cell = lambda rows: {cell: [w for *at, w in rows if tuple(at) == cell] for cell in {(k, c) for k, c, _ in rows}}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(closing, "RUNS", runs)
        patch.setattr(closing, "SPREAD", spread)
        rows = closing._runs(pd.DataFrame(updates, columns=["k", "col", "w"]), ["k"])
        assert rows["cols"].map(len).max() <= runs
        back = []
        for key, group in rows.groupby("k", dropna=False, sort=False):
            for cols, w in closing.spread(group):
                assert 0 < len(cols) <= spread
                back += of(None if pd.isna(key) else key, cols, w)
    assert by_cell(back) == by_cell(updates)


@pytest.mark.parametrize("windows", [False, True])
def test_states_read_runs_of_a_task(spark, tmp_path, monkeypatch, windows):
    """A state reads few rows, however many updates there are."""
    module, name = (closing, "Thresholds") if windows else (stateful, "Threshold")

    class Counting(getattr(module, name)):
        def handleInputRows(self, key, rows, timer_values):  # noqa: N802
            n = [float(sum(map(len, rows)))]
            yield self._message(key, [0], n, False) if windows else pd.DataFrame({"row": [key[0]], "col": [0], "d": n})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            return iter(())

    monkeypatch.setattr(module, name, Counting)
    rows = spark.range(0, 50_000, 1, 2).select(F.timestamp_seconds(F.col("id") % 3600).alias("ts"), (F.col("id") % 100).alias("k"))
    write(rows, f"{tmp_path}/t.parquet")
    stream, shape = frames.watermarked(tables.stream(spark, str(tmp_path), "t"), "ts", "0 seconds"), Shape(2, 64)
    made = closing.window_thresholds(stream, "ts", "k", "1 day", 8, None, shape) if windows else stateful.thresholded(stream, "k", 8, shape)
    read = [r.d for r in stateful.drained(made).collect()]
    assert len(read) == 2 and max(read) <= 8


@pytest.mark.parametrize("signed", [False, True])
def test_thresholds_of_weights_in_order(spark, tmp_path, signed):
    """One file read by one task, two micro-batches: the messages of each cell are those of one update after the other."""
    from cellmesh.operators.linear import addressed

    r, shape = random.Random(3), Shape(2, 4, signed=signed)
    schema, files = "i int, k string, w double", [[(a + i, r.choice("abcdef"), r.choice([1.0, 1.0, 2.0, 5.0])) for i in range(400)] for a in (0, 400)]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).sortWithinPartitions("i").write.mode("append").parquet(f"{tmp_path}/t.parquet")
    got = stateful.drained(stateful.thresholded(tables.stream(spark, str(tmp_path), "t", 1), "k", 7, shape, "w")).collect()
    cells, found = defaultdict(list), defaultdict(list)
    for x in addressed(spark.createDataFrame([x for rows in files for x in rows], schema), "k", shape).orderBy("i").collect():
        cells[x.row, x.col].append(x.sign * x.w)
    for x in got:
        found[x.row, x.col].append(x.d)
    expected = {cell: sorted(d for _, d in one_by_one(w, [7.0] * len(w), 0.0, signed)[0]) for cell, w in cells.items()}
    assert {cell: sorted(d) for cell, d in found.items()} == {cell: d for cell, d in expected.items() if d}


def test_files_in_order(spark, tmp_path):
    """Files written side by side are read in the order of their names; a stream that drops rows says so."""
    df = spark.range(0, 400, 1, 4).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 7).alias("k"))
    path = tables.in_order(spark, write(df, f"{tmp_path}/t.parquet"))
    assert path.endswith("t.parquet")
    for _ in range(2):
        stream = frames.watermarked(tables.stream(spark, str(tmp_path), "t", 1), "ts", "0 seconds")
        cells = stateful.drained(frames.windowed_cells(stream, "ts", "k", "1 day", shape=Shape(1, 8)), whole=True)
        assert cells.agg(F.sum("v")).first()[0] == 24 * 16
    backwards = df.repartitionByRange(4, F.desc("ts"))
    tables.in_order(spark, write(backwards, f"{tmp_path}/back/t.parquet"))
    stream = frames.watermarked(tables.stream(spark, f"{tmp_path}/back", "t", 1), "ts", "0 seconds")
    with pytest.raises(stateful.LateRows):
        stateful.drained(frames.windowed_cells(stream, "ts", "k", "1 day", shape=Shape(1, 8)), whole=True)


def write(df, path):
    df.write.parquet(path)
    return path


# --- sketches in a stream's state ---


def as_stream(spark, path, rows, schema, files=4):
    n = -(-len(rows) // files)
    for a in range(0, len(rows), n):
        spark.createDataFrame(rows[a : a + n], schema).coalesce(1).write.mode("append").parquet(f"{path}/t.parquet")
    return tables.stream(spark, str(path), "t", 1)


def test_buckets_take_what_the_invariant_lets_them():
    rng = np.random.default_rng(1)
    for c in (2, 6):
        sizes = rng.integers(1, 4, 300)
        start = sketches.cuts(sizes, c)
        total = np.concatenate([[0], np.cumsum(sizes)])
        assert start[0] == 0 and len(start) < 120
        for a, b in zip(start, [*start[1:], len(sizes)], strict=True):
            assert b == a + 1 or total[b] - total[a] <= total[a] // c + 1
            assert b == len(sizes) or total[b + 1] - total[a] > total[a] // c + 1 or b + 1 == a + 1


def test_sliding_sketches(spark, tmp_path):
    """Buckets hold exactly the cells of their events, late ones too; those before the window are gone."""
    r = random.Random(2)
    rows = [("x" if i % 3 else None, max(0, i - r.randint(0, 30)), f"k{r.randint(0, 5)}", float(r.randint(1, 99))) for i in range(600)]
    shape = Shape(2, 8)
    made = as_stream(spark, tmp_path, [*rows, ("x", None, "k0", 1.0), ("x", 599, None, None)], "series string, ts bigint, k string, v double")
    buckets = sketches.last(stateful.drained(sketches.sliding_cells(made, "series", "ts", "k", 10, 200, shape), "update"), ["series", "part"])
    held = buckets.collect()
    for series in ("x", None):
        own = [b for b in held if b.series == series]
        assert {(b.min_ts, b.max_ts, b.size) for b in own if b.part == 0} == {(b.min_ts, b.max_ts, b.size) for b in own if b.part == 1}
        inside = [x for x in rows if x[0] == series and x[1] >= max(y[1] for y in rows if y[0] == series) - 200]
        n = sum(b.size for b in own if b.part == 0)
        assert len(inside) <= n <= len(inside) * (1 + 1 / 6) + 1
        assert all(sum(b.v) == b.size for b in own) and len(own) < 2 * 60
        # As the sketch of the newest n events.
        newest = sorted((x for x in rows if x[0] == series), key=lambda x: x[1])
        oldest = min(b.min_ts for b in own)
        whole = Linear.build(spark.createDataFrame([(x[2],) for x in newest if x[1] > oldest], "k string"), "k", shape=shape)
        cells = {(e.row, e.col): e.v for e in sketches.entries(buckets.where(F.col("series").eqNullSafe(F.lit(series)))).collect()}
        for c in whole.cells.collect():
            assert c.v <= cells[c.row, c.col] <= c.v + 30
    highest = sketches.sliding_registers(made, "series", "ts", "k", 10, 10_000)
    found = sketches.entries(sketches.last(stateful.drained(highest, "update"), ["series", "part"]), ("part", "reg", "rho"), True)
    df = spark.createDataFrame(rows, "series string, ts bigint, k string, v double")
    expected = {(x.series, x.reg, x.rho) for x in HLL.build(df, "k", "series").registers.collect()}
    assert {(x.series, x.reg, int(x.rho)) for x in found.collect()} == expected
    sent = stateful.drained(sketches.register_changes(made, "k", "series"))
    assert {(x.series, x.reg, x.rho) for x in sent.groupBy("series", "reg").agg(F.max("new").alias("rho")).collect()} == {(s, g, rho) for s, g, rho in expected}
    assert sent.where("new <= old").count() == 0


@pytest.mark.parametrize("salts", [1, 4])
def test_streamed_hitters(spark, tmp_path, salts):
    r = random.Random(5)
    rows = [(int(r.paretovariate(0.6)) % 500, r.choice([1.0, 2.5, 0.0, -3.0, None])) for _ in range(3000)]
    made = as_stream(spark, tmp_path, [*rows, (None, 5.0)], "k int, w double")
    found = {x.key: x for x in sketches.hitters(stateful.drained(sketches.tracked(made, "k", 25, "w", salts=salts), "update"), 25).collect()}
    true = defaultdict(float)
    for k, w in rows:
        if w and w > 0:
            true[str(k)] += w
    total = sum(true.values())
    assert len(found) == 25 and all(k in found for k, w in true.items() if w > total / 25)
    assert all(x.cnt >= true[k] - 1e-9 and x.cnt - x.err <= true[k] + 1e-9 for k, x in found.items())


def test_trees_of_merges(spark, monkeypatch):
    """The depth of a reduction tree follows the number of tasks, and no step merges more than its fan-in."""
    df = spark.range(0, 4000, 1, 40).withColumn("k", F.col("id") % 50)
    assert [frames_of.rounds(df, n) for n in (2, 4, 40, 128)] == [6, 3, 1, 1]
    assert frames_of.rounds(df.groupBy("k").count(), 128) == 1
    for module in (kll, heavy):
        monkeypatch.setattr(module, "FAN_IN", 2)
    sketch = kll.KLL.build(df, "id", k=64)
    assert sketch.counts.first().n == 4000 and sketch.items.count() < 64 * 6
    weight = sketch.weighted().agg(F.sum("w")).first()[0]
    assert abs(weight - 4000) <= 400 and abs(sketch.quantiles([0.5]).first().value - 2000) <= 400
    table = heavy.Coco.build(df, "k", 2, 64).table
    assert table.agg(F.sum("val")).first()[0] == 4000 and table.groupBy("row", "col").count().where("count > 1").count() == 0


def test_a_layer_of_many_kinds(spark):
    rows = [(str(i % 40) if i % 9 else ("a" if i % 2 else ""),) for i in range(900)] + [(None,)]
    df = spark.createDataFrame(rows, "k string").repartition(3)
    kinds = {"it's": Shape(2, 16), "cs": Shape(2, 16, signed=True), "h": "sparse", "d": Mapping(0.02), "r": layer.Ranks(), "o": layer.Owners(2, 64)}
    built = layer.build(df, "k", kinds)
    numbers = [float(k) for (k,) in rows if k and k != "a"]
    assert built["it's"].l1().first().l1 == 900 and built["r"].counts.first().n == len(numbers)
    assert sorted(x.item for x in built["r"].items.where("level = 0").collect()) == sorted(numbers) or built["r"].items.count() < len(numbers)
    assert built["o"].partial(F.lit(True)).first().estimate == sum(bool(k) for (k,) in rows)
    assert built["d"].buckets.agg(F.sum("cnt")).first()[0] == sum(x > 0 for x in numbers)
    assert layer.query(built, df.limit(3), "k", "frequency").where("error is null").select("sketch").distinct().count() == 3
    none = layer.build(df.limit(0), "k", kinds)
    assert none["r"].counts.first().n == 0 and none["o"].table.count() == 0 and none["it's"].cells.count() == 0


def test_mixed_heads(spark):
    df = spark.createDataFrame([("a=1;b=2", "x", 1.0, 5), ("a=1;b=2", "y", 2.0, 6), ("a=1", "x", None, 7), ("a=1", None, -1.0, None)], "l string, u string, v double, o int")
    heads = {"user": ("u", "hll"), "value": ("v", "dd"), "order": ("o", "cm"), "sign's": ("o", "cs")}
    grid = hydra.MultiHead.build(df, F.col("l"), heads, width=256)
    probes = spark.createDataFrame([("a=1",), ("b=2",), ("a=1;b=2",), ("c=3",)], "s string")
    ask = lambda *a, **k: {r.s: r.estimate for r in grid.query(probes, "s", *a, **k).collect()}
    assert ask("user", "cardinality") == {"a=1": 2, "b=2": 2, "a=1;b=2": 2, "c=3": 0}
    assert ask("value", "quantile", q=1.0)["a=1"] == pytest.approx(2.0, rel=0.02)
    items = probes.withColumn("o", F.lit("5"))
    assert {r.s: r.estimate for r in grid.query(items, "s", "order", "frequency", item="o").collect()} == {"a=1": 1, "b=2": 1, "a=1;b=2": 1, "c=3": 0}
    both = grid.merge(grid)
    assert {r.s: r.estimate for r in both.query(items, "s", "sign's", "frequency", item="o").collect()}["b=2"] == 2
    with pytest.raises(UnsupportedQuery):
        grid.query(probes, "s", "user", "quantile", q=0.5)
    with pytest.raises(UnsupportedQuery):
        grid.head("none")
    with pytest.raises(Mismatch):
        grid.merge(hydra.MultiHead.build(df, F.col("l"), heads, width=64))


def test_cuts_by_mass(spark):
    """Leaves in order, none left out; a part of several leaves has at most a k-th of the newer mass, and parts are few."""
    n, k = 2000, 10
    df = spark.range(n).select(F.col("id").alias("t"), F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 50).alias("key"), (F.col("id") % 2).alias("s"))
    dealt = windows.leaves(df, "t", "s", 1500, leaf=4)
    found = windows.by_l2_tree(dealt, "key", k).collect()
    true = defaultdict(lambda: defaultdict(int))
    for r in dealt.collect():
        true[r.series, r.slot][r.key] += 1
    for series in ("0", "1"):
        own = sorted((x.slot, x.part, x.l2) for x in found if x.series == series)
        assert [s for s, *_ in own] == list(range(len(own))) and len(own) == sum(s == series for s, _ in true)
        assert [p for _, p, _ in own] == sorted(p for _, p, _ in own)
        parts = defaultdict(list)
        for s, p, m in own:
            parts[p].append((s, m))
        newer = 0.0
        for p in sorted(parts):
            mass = parts[p][0][1] ** 2
            assert len(parts[p]) == 1 or mass <= newer / k + 1e-6
            newer += mass
        assert 10 < len(parts) < 80 < len(own)
        exact = defaultdict(int)
        for s, _ in parts[max(parts)]:
            for key, c in true[series, s].items():
                exact[key] += c
        assert abs(parts[max(parts)][0][1] - sum(c * c for c in exact.values()) ** 0.5) <= 0.15 * sum(c * c for c in exact.values()) ** 0.5
    assert windows.by_l2_tree(windows.leaves(df.limit(0), "t"), "key").count() == 0


def test_partial_keys_by_a_function(spark):
    """Many partial keys against one table: exactly its sums, whatever the function; keys are found by their parts alone."""
    rows = [(f"{a}:{b}", g) for a in ("x", "y", "xy") for b in range(12) for g in (1, None) for _ in range(b + 1)]
    df = spark.createDataFrame(rows, "k string, g int")
    sketch = heavy.Coco.build(df, "k", 2, 16, by="g")
    table = defaultdict(int)
    for r in sketch.table.collect():
        table[r.g, r.key] += r.val
    probes = [(p, g) for p in ("x", "y", "1", "11", "z", None) for g in (1, None, 2)]
    by_part = sketch.partials(spark.createDataFrame(probes, "p string, g int"), "p", lambda f, p: pd.Series([x.startswith(y + ":") for x, y in zip(f, p)]), lambda k: F.split(k, ":"))
    got = {(r.p, r.g): r.estimate for r in by_part.collect()}
    assert got == {(p, g): sum(v for (h, k), v in table.items() if h == g and k.startswith(f"{p}:")) for p, g in probes if p is not None}
    assert got["x", 1] > 0 and got["1", 1] == 0
