"""Edge cases, algebra and error bounds."""

import dataclasses
import math
import struct

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmesh.functions import hashing
from cellmesh.operators import heavy, hll, hydra, layer, sampling, windows, workers
from cellmesh.operators.ddsketch import DDSketch
from cellmesh.operators.frames import Mismatch, UnsupportedQuery
from cellmesh.operators.heavy import Coco
from cellmesh.operators.hll import HLL
from cellmesh.operators.hydra import Hydra
from cellmesh.operators.kll import KLL
from cellmesh.operators.linear import Linear, Shape, Tally, rows_of_mask
from cellmesh.operators.tracked import Tracked
from cellmesh.operators.univmon import Pyramid, UnivMon
from cellmesh.operators.windows import Hybrid
from cellmesh.sources import codecs, portable, tables
from cellmesh.streaming.tau import Controller, replay


@pytest.fixture(scope="module")
def zipf(spark):
    keys = np.minimum(np.random.default_rng(42).zipf(1.1, 40_000), 8192)
    return spark.createDataFrame([(int(i), int(k)) for i, k in enumerate(keys)], "i bigint, k bigint").cache()


def truth(df, key="k"):
    return {r[key]: r["count"] for r in df.groupBy(key).count().collect()}


def test_known_counts(spark):
    known = {"oak": 310, "ash": 1, "elm": 77, "yew": 4200, "fir": 18}
    df = spark.createDataFrame(list(known.items()), "k string, n bigint")
    for cols in (13, 1500, 1024):
        found = {r.k: r.estimate for r in Linear.build(df, "k", "n", shape=Shape(4, cols)).estimate(df, "k").collect()}
        assert all(found[k] >= n for k, n in known.items()) and found["yew"] <= sum(known.values())


@pytest.mark.parametrize("profile", ["md5", "xx64", "xxh3"])
@pytest.mark.parametrize("shape", [(5, 2048), (8, 2048), (3, 1 << 30), (5, 1000)])
def test_profiles_and_modes(zipf, profile, shape):
    """Whether rows are slices of one hash, of two or have their own: bounds hold, and cells of a key are those that Python computes."""
    made = Shape(*shape, profile=profile)
    true = truth(zipf)
    found = {r.k: r.estimate for r in Linear.build(zipf, "k", shape=made).estimate(zipf, "k").collect()}
    assert all(n <= found[k] <= n + 0.01 * 40_000 for k, n in true.items())
    if profile == "md5":
        cells = {(r.row, r.col) for r in Linear.build(zipf, "k", shape=made).cells.collect()}
        assert cells == {(i, c) for k in true for i, c in enumerate(hashing.md5_columns(str(k), *shape))}


@pytest.mark.parametrize("by", [(), ("g",)])
def test_signed_estimates_with_and_without_groups(zipf, by):
    df = zipf.withColumn("g", F.col("i") % 2)
    shape = Shape(4, 1024, signed=True)
    found = Linear.build(df, "k", by=by, shape=shape).estimate(df, "k").collect()
    true = {tuple(r[:-1]): r["count"] for r in df.groupBy("k", *by).count().collect()}
    far = [abs(r.estimate - true[(r.k, *(r[b] for b in by))]) for r in found]
    assert len(found) == len(true) and np.quantile(far, 0.95) <= 0.02 * 40_000


def test_nothing_comes_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert Linear.build(empty, "k").cells.count() == 0
    assert HLL.build(empty, "k").registers.count() == 0
    assert DDSketch.build(empty, "v").buckets.count() == 0
    assert KLL.build(empty, "v").items.count() == 0
    assert heavy.space_saving(empty, "k").count() == 0
    assert Coco.build(empty, "k").table.count() == 0
    assert heavy.elastic(empty.withColumn("o", F.lit(1)), "k", "o").heavy.count() == 0
    assert Hybrid.build(empty, "k").l2().count() == 0
    assert windows.assigned(empty.withColumn("t", F.lit(None).cast("bigint")), "t").count() == 0
    assert UnivMon.build(empty, "k").cells.count() == 0
    nulls = spark.createDataFrame([(None, 1.0), ("a", None), ("b", 0.0)], "k string, w double")
    assert Linear.build(nulls, "k", "w").cells.count() == 0


def test_count_min_bounds(zipf):
    true = truth(zipf)
    found = {r.k: r.estimate for r in Linear.build(zipf, "k").estimate(zipf, "k").collect()}
    assert all(found[k] >= n for k, n in true.items())
    inside = sum(found[k] - n <= math.e / 2048 * 40_000 for k, n in true.items()) / len(true)
    assert inside >= 1 - math.exp(-5)


def test_sampled_hot_key_is_scaled(zipf):
    hot, n = max(truth(zipf).items(), key=lambda x: x[1])
    for sketch in (sampling.sampled(zipf, "k", "i", 0.1, Shape(5, 8192)), sampling.sampled_per_row(zipf, "k", "i", 0.5, Shape(5, 8192))):
        found = sketch.estimate(zipf.where(F.col("k") == hot), "k").first().estimate
        assert abs(found - n) / n <= 0.15


def test_parameters_must_agree(zipf):
    a, b = Linear.build(zipf, "k"), Linear.build(zipf, "k", shape=Shape(5, 1024))
    with pytest.raises(Mismatch):
        a.merge(b)
    with pytest.raises(Mismatch):
        DDSketch.build(zipf, "k", alpha=0.01).merge(DDSketch.build(zipf, "k", alpha=0.02))
    with pytest.raises(Mismatch):
        hll.hip_merge()
    with pytest.raises(UnsupportedQuery):
        Linear.build(zipf, "k").l2()
    with pytest.raises(UnsupportedQuery):
        hll.query(HLL.build(zipf, "k"), "frequency")
    with pytest.raises(Mismatch):
        layer.merge(a, HLL.build(zipf, "k"))
    with pytest.raises(ValueError):
        Shape(3, 1000, signed=True)


def test_count_sketch_linearity(zipf):
    shape = Shape(signed=True)
    whole = Linear.build(zipf, "k", shape=shape)
    gone = whole.merge(Linear.build(zipf, "k", F.lit(-1.0), shape=shape))
    assert gone.cells.where("v <> 0").count() == 0
    l2 = math.sqrt(sum(n * n for n in truth(zipf).values()))
    assert abs(whole.l2().first().l2 - l2) / l2 < 0.05


def test_delta_cells_outside_are_skipped(spark, zipf):
    sketch = Linear.build(zipf, "k", shape=Shape(2, 16))
    extra = spark.createDataFrame([(7, 0, 5.0), (0, 99, 5.0)], "row int, col int, d double")
    assert sketch.apply(extra).cells.agg(F.sum("v")).first()[0] == 80_000


def test_row_mask(spark):
    rows = spark.createDataFrame([(0,), (5,), (31,)], "m bigint").select(rows_of_mask(F.col("m"), 5).alias("r")).collect()
    assert [r.r for r in rows] == [[], [0, 2], [0, 1, 2, 3, 4]]


@pytest.mark.parametrize("n", [1, 100, 5000, 60_000])
def test_hll_error(spark, n):
    df = spark.range(n).select(F.concat(F.lit("hll:"), F.col("id")).alias("k"))
    for variant in ("ertl", "sparse"):
        assert abs(HLL.build(df, "k", variant=variant).estimate().first().estimate - n) <= max(1, 0.03 * n)
    for profile in ("xx64", "xxh3"):
        assert abs(HLL.build(df, "k", profile=profile).estimate().first().estimate - n) <= max(1, 0.03 * n)


def test_hip_error(spark):
    df = spark.range(20_000).select("id", F.col("id").cast("string").alias("k"))
    assert abs(hll.hip(df, "k", "id").first().estimate - 20_000) <= 600


def test_dd_drops_what_cannot_be_indexed(spark):
    values = [0.0, -3.0, float("nan"), float("inf"), None, 1.0, 2.0]
    sketch = DDSketch.build(spark.createDataFrame([(v,) for v in values], "v double"), "v")
    row = sketch.summary.first()
    assert (row["count"], row["min"], row["max"], row["dropped"]) == (2, 1.0, 2.0, 4)
    with pytest.raises(UnsupportedQuery):
        sketch.quantiles([1.5])


def test_dd_relative_error(spark):
    values = np.sort(np.exp(8 * np.random.default_rng(123).random(20_000) - 2))
    sketch = DDSketch.build(spark.createDataFrame([(float(v),) for v in values], "v double"), "v")
    for r in sketch.quantiles([0.01, 0.5, 0.99]).collect():
        exact = values[math.ceil(r.q * len(values)) - 1]
        assert abs(r.value - exact) / exact <= 0.01 + 1e-6
    small = sketch.max_bins(32)
    assert small.buckets.count() <= 32 and small.buckets.agg(F.sum("cnt")).first()[0] == 20_000


def test_kll_rank_error_and_merge(spark):
    values = np.random.default_rng(7).exponential(1000, 20_000)
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(values)], "v double, h int").repartition(8)
    whole = KLL.build(df, "v")
    merged = KLL.build(df.where("h = 0"), "v").merge(KLL.build(df.where("h = 1"), "v"))
    for sketch in (whole, merged):
        assert sketch.counts.first().n == 20_000
        assert sketch.items.count() < 1200
        for r in sketch.quantiles([0.1, 0.5, 0.9]).collect():
            assert abs((values <= r.value).mean() - r.p) <= 0.03
    assert KLL.build(df, "v", "h").quantiles([0.5]).count() == 2


def test_space_saving_guarantees(spark, zipf):
    true, k = truth(zipf), 50
    found = {r.key: r for r in heavy.space_saving(zipf.repartition(5), "k", k).collect()}
    assert len(found) <= k
    assert all(r.cnt - r.err <= true[int(key)] <= r.cnt for key, r in found.items())
    assert {str(key) for key, n in true.items() if n > 40_000 / k} <= set(found)


def test_space_saving_of_many_groups(spark, monkeypatch):
    """Groups beyond what a task holds are given out early, and merge."""
    monkeypatch.setattr(heavy, "HELD", 5)
    rows = [(g, f"k{j % (1 + g % 4)}") for g in range(40) for j in range(12)] + [(1000, "hot")] * 500
    df = spark.createDataFrame(rows, "g int, k string").orderBy("k").coalesce(1)
    true = {(r.g, r.k): r["count"] for r in df.groupBy("g", "k").count().collect()}
    found = heavy.space_saving(df, "k", 10, by="g").collect()
    assert {(r.g, r.key): r.cnt for r in found} == true
    sketch = KLL.build(df.withColumn("v", F.length("k").cast("double")), "v", "g")
    assert {r.g: r.n for r in sketch.counts.collect()}[1000] == 500 and sketch.items.select("g").distinct().count() == 41


def test_coco_keeps_mass_and_heavy_keys(zipf):
    sketch = Coco.build(zipf, "k", 5, 2048)
    assert sketch.table.agg(F.sum("val")).first()[0] == 40_000
    found = {r.key: r.estimate for r in sketch.estimate().collect()}
    big = [str(k) for k, n in truth(zipf).items() if n > 400]
    assert sum(k in found for k in big) / len(big) >= 0.9
    grouped = Coco.build(zipf.withColumn("g", F.col("i") % 3), "k", 2, 64, by="g")
    assert sum(r.estimate for r in grouped.partial(F.lit(True)).collect()) == 40_000


def test_elastic_owner_and_light(spark):
    flows = ["big"] * 150 + ["late"] * 20
    df = spark.createDataFrame(list(enumerate(flows)), "i bigint, f string")
    sketch = heavy.elastic(df, "f", "i", 1)
    assert {r.f: r.estimate for r in heavy.elastic_query(sketch, df, "f").collect()} == {"big": 150, "late": 20}
    turned = spark.createDataFrame(list(enumerate(["a"] + ["b"] * 9)), "i bigint, f string")
    sketch = heavy.elastic(turned, "f", "i", 1)
    assert sketch.heavy.first().mixed and {r.f: r.estimate for r in heavy.elastic_query(sketch, turned, "f").collect()} == {"a": 1, "b": 9}


def test_elastic_runs_are_their_items_one_by_one():
    rng = np.random.default_rng(3)
    for _ in range(50):
        runs = [(str(rng.integers(3)), int(rng.integers(1, 40))) for _ in range(12)]
        whole, single = heavy.Vote(), heavy.Vote()
        for flow, n in runs:
            whole.run(flow, n)
            for _ in range(n):
                single.run(flow, 1)
        assert vars(whole) == vars(single)


def test_elastic_ranges_lose_nothing(zipf):
    true = truth(zipf)
    sketch = heavy.elastic(zipf, "k", "i", 8, every=1000)
    light = sketch.light.l1().first().l1
    assert sketch.heavy.agg(F.sum("vote_pos")).first()[0] + light == 40_000
    assert all(r.estimate >= true[int(r.k)] for r in heavy.elastic_query(sketch, zipf, "k").collect())


def test_univmon_small_set(spark):
    df = spark.createDataFrame([("red", 3), ("blue", 2), ("red", 4), ("green", 12), ("grey", 6)], "k string, w bigint")
    u = UnivMon.build(df, "k", "w", pyramid=Pyramid(layers=8))
    p = np.array([7, 2, 12, 6]) / 27
    assert u.l1().first().l1 == 27
    assert abs(u.entropy().first().entropy + (p * np.log2(p)).sum()) < 1e-9
    assert u.cardinality().first().cardinality == 4
    assert [r.key for r in u.top_k(2).orderBy("rk").collect()] == ["green", "red"]
    assert UnivMon.build(df, "k", "w", track=False).top.count() == 0


def test_univmon_merge(spark):
    a = UnivMon.build(spark.createDataFrame([("x", 4)], "k string, w bigint"), "k", "w")
    b = UnivMon.build(spark.createDataFrame([("x", 9), ("y", 2)], "k string, w bigint"), "k", "w")
    u = a.merge(b)
    assert u.l1().first().l1 == 15
    found = {r.k: r.cnt for r in u.frequency(spark.createDataFrame([("x",), ("y",)], "k string"), "k").collect()}
    assert found == {"x": 13, "y": 2}


def test_hydra_subsets_and_support(spark):
    df = spark.createDataFrame([("a=1;b=2", 7)], "l string, w bigint")
    h = Hydra.build(df, F.col("l"), weight="w", kind="cm")
    probes = spark.createDataFrame([("a=1",), ("b=2",), ("a=1;b=2",), ("b=3",)], "s string")
    assert {r.s: r.estimate for r in h.query(probes, "s", "frequency").collect()} == {"a=1": 7, "b=2": 7, "a=1;b=2": 7, "b=3": 0}
    with pytest.raises(Exception, match="parts"):
        df.select(hydra.expand_subkeys(F.lit(";".join("abcdefghijklm")))).collect()
    with pytest.raises(UnsupportedQuery):
        h.query(probes, "s", "entropy")
    with pytest.raises(UnsupportedQuery):
        hydra.global_answer(h, "l1")


def test_eh_invariant(spark):
    df = spark.range(5000).select(F.col("id").alias("t"), (F.col("id") % 2).cast("string").alias("s"))
    rows = windows.buckets(windows.assigned(df, "t", "s", k=10, window=2000), "t").orderBy("series", "slot").collect()
    for series in "01":
        newer = 0
        for r in (r for r in rows if r.series == series):
            assert r.size <= newer / 6 + 1 and r.min_ts >= 4999 - 1 - 2000
            newer += r.size
        assert newer == 1001
    n = windows.count_between(windows.buckets(windows.assigned(df, "t", k=50, window=1000), "t"), 4500, 4999).first()["count"]
    assert abs(n - 500) <= 25


def test_eh_without_order(spark):
    """Late and equal times: ranks follow time, whatever the order of rows."""
    times = [5, 3, 3, 9, 1, 9, 9, 7, 100]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "t bigint, i bigint").repartition(5)
    got = sorted((r.t, r.slot) for r in windows.assigned(df, "t", k=2, window=1000, ties=("i",)).collect())
    rank = {i: k for k, (_, i) in enumerate(sorted((-t, i) for i, t in enumerate(times)))}
    level = lambda r: (r // 2 + 1).bit_length() - 1
    slot = lambda r: level(r) * 2 + (r - 2 * ((1 << level(r)) - 1) >> level(r))
    assert got == sorted((t, slot(rank[i])) for i, t in enumerate(times))


def test_stream_buckets_keep_the_invariant():
    rng = np.random.default_rng(1)
    held, seen = [], []
    for _ in range(60):
        fresh = [int(t) for t in rng.integers(0, 3000, 50)]
        seen += fresh
        held = windows.compacted([*held, *([t, t, 1] for t in fresh)], 10, 10_000)
        newer = 0
        for low, high, n in held:
            assert low <= high and n <= newer // 6 + 1
            newer += n
        assert newer == len(seen)
    assert len(held) < 80
    assert windows.compacted([[0, 10, 5], [5000, 5000, 1]], 10, 100) == [[5000, 5000, 1]]


def test_crossings_add_up(spark, zipf):
    df = zipf.withColumns({"w": (F.col("i") % 7 - 2).cast("double"), "g": (F.col("i") % 3).cast("int")})
    for shape in (Shape(3, 64), Shape(3, 64, signed=True)):
        sent = workers.crossings(df, "k", "i", 15, shape, "w", "g").cache()
        exact = {(r.row, r.col): r.v for r in Linear.build(df, "k", "w", shape=shape).cells.where("v <> 0").collect()}
        assert {(r.row, r.col): r.v for r in workers.aggregated(sent, shape).cells.collect()} == exact
        assert sent.where("not flush and abs(d) < 15").count() == 0
    assert workers.crossings(df.limit(0), "k", "i", 15).count() == 0


def test_tau_blocks(spark):
    rng = np.random.default_rng(2)
    depths = [int(x) for x in rng.integers(-20, 200, 700)]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(depths)], "i bigint, q bigint").repartition(4)
    c = Controller(start=3, most=9, least=2)
    expected, now, before = [], c.start, None
    for q in depths:
        now = c.adjust(now, q, before)
        before = max(0, q)
        expected.append(now)
    for block in (7, 256, 10_000):
        got = [r.tau for r in replay(df, "i", "q", c, block=block).orderBy("i").collect()]
        assert got == expected


def test_hashes_of_numbers(spark):
    """Words derived from one hash, and bits of doubles, as plain Python computes them."""
    word = (1 << 64) - 1

    def final(x):
        x = (x + hashing.GOLDEN) & word
        x = (x ^ x >> 30) * hashing.MIX_A & word
        x = (x ^ x >> 27) * hashing.MIX_B & word
        return x ^ x >> 31

    df = spark.createDataFrame([(0,), (-5,), (2**62,), (None,)], "h bigint")
    for shape, make in (((5, 2048), lambda h: [h]), ((8, 4096), lambda h: [h, final(h ^ hashing.GOLDEN)])):
        got = {r.h: r.m for r in df.select("h", hashing.matrix_hash(*shape)(F.col("h")).alias("m")).collect()}
        assert got == {h: None if h is None else [hashing.signed(x) for x in make(h & word)] for h in (0, -5, 2**62, None)}
    assert len(df.select(hashing.matrix_hash(20, 4096)(F.col("h")).alias("m")).first().m) == 20
    values = spark.createDataFrame([(1.5,), (-0.0,), (None,)], "v double")
    text, raw = (values.select(hashing.float_bits(t)(F.col("v")).alias("b")) for t in (True, False))
    bits = [int.from_bytes(struct.pack("<d", v), "little") for v in (1.5, -0.0)]
    assert [r.b for r in text.collect()] == [*map(str, bits), None]
    assert [None if r.b is None else bytes(r.b) for r in raw.collect()] == [struct.pack("<d", 1.5), struct.pack("<d", -0.0), None]


def test_controller():
    c = Controller(start=10, step=1, target=5, deadband=1, least=1, most=12)
    assert c.adjust(10, 20, 10) == 11 and c.adjust(12, 20, 10) == 12 and c.adjust(10, 0, 5) == 9 and c.adjust(10, 5, 5) == 10
    assert Controller(step=0).adjust(7.0, 500, None) == 7.0


def test_codecs(spark, zipf):
    for x in (None, True, 0, 127, 128, 65536, -1, -33, -(2**40), 1.5, "ü" * 40, b"x" * 300, [1, [2.5, "a"]], {"a": 1, "b": [None]}):
        assert codecs.unpack(codecs.pack(x)) == x
    with pytest.raises(ValueError):
        codecs.unpack(codecs.pack("abc")[:-1])
    kind, meta, payload = codecs.open_sealed(codecs.seal("ddsketch", {"v": 1}, b"body") + b"more")
    assert (kind, meta, payload) == ("ddsketch", {"v": 1}, b"body")
    with pytest.raises(ValueError):
        codecs.open_sealed(b"nothing")
    with pytest.raises(Mismatch):
        codecs.cm_frame([[1.0], [1.0, 2.0]], False)
    assert codecs.is_delta(codecs.heap_delta_frame(2, 2, [(0, 1, -3)], [("a", 2.0)], 5)) and not codecs.is_delta(codecs.heap_frame([[1.0]], [], 5))
    assert codecs.heap_delta_values(codecs.heap_delta_frame(2, 2, [(0, 1, -3)], [("a", 2.0)], 5)) == (2, 2, [(0, 1, -3)], [("a", 2.0)], 5)
    with pytest.raises(Mismatch):
        codecs.heap_delta_values(codecs.heap_delta_frame(2, 2, [(2, 1, -3)], [], 5))
    with pytest.raises(ValueError):
        codecs.heap_delta_values(codecs.heap_frame([[1.0]], [], 5))


def test_every_kind_is_sealed():
    assert len(codecs.KINDS) == 58 and len(set(codecs.KINDS.values())) == 58
    for kind in codecs.KINDS:
        if kind in codecs.BARE:
            with pytest.raises(ValueError):
                codecs.seal(kind, {}, b"")
        else:
            assert codecs.open_sealed(codecs.seal(kind, {"m": 1}, b"xy")) == (kind, {"m": 1}, b"xy")
    whole = codecs.seal("kll", {}, b"xy")
    for n in range(len(whole)):
        with pytest.raises(ValueError):
            codecs.open_sealed(whole[:n])


def test_metadata_is_strict():
    profile = codecs.HashProfile()
    meta = codecs.unpack(codecs.pack(codecs.metadata(1, profile, rows=3)))
    assert codecs.read_metadata(meta, 1, profile, rows=int) == {"rows": 3}
    other = dataclasses.replace(profile, seeds=(1, 2))
    wrong = [(meta, 2, profile, {"rows": int}), (meta, 1, other, {"rows": int}), (meta, 1, profile, {}), (meta, 1, profile, {"rows": str}), (meta, 1, profile, {"rows": int, "cols": int}), (meta, 1, None, {"rows": int})]
    for found, version, p, kinds in wrong:
        with pytest.raises(Mismatch):
            codecs.read_metadata(found, version, p, **kinds)


def test_messages_refuse_what_is_wrong(spark, zipf):
    shape = Shape(2, 16)
    sketch = Linear.build(zipf, "k", shape=shape)
    data = bytes(portable.to_messages(sketch).first().data)
    for n in range(1, len(data) - 1, 7):
        with pytest.raises(ValueError):
            portable._linear_rows(portable.decode("Envelope", data[:n]).get("count_min", {}), shape)
    for bad in (b"\xff\xff", b"\x9a\x06\x01a", b"\x0d\x00"):
        with pytest.raises(ValueError):
            portable.decode("Envelope", bad)
    with pytest.raises(Exception, match="another shape"):
        portable.from_messages(portable.to_messages(sketch), Linear(sketch.cells, Shape(2, 32))).cells.count()
    with pytest.raises(ValueError):
        portable.unpacked_registers(portable.packed_registers([(3, 1), (3, 2)]))
    assert portable.unpacked_registers(portable.packed_registers([(0, 1), (5, 51), (16383, 2)])) == [(0, 1), (5, 51), (16383, 2)]
    assert portable.fixed_point([float(x) for x in range(7, 57)]) == {"offset": 7.0, "value_scale": 0, "residuals": list(range(50))}
    assert portable.fixed_point([0.25, 1.5])["value_scale"] == -2 and portable.fixed_point([math.pi, 1.0]) is None and portable.fixed_point([math.inf]) is None


def test_snapshots(spark, zipf, tmp_path):
    df = zipf.limit(500).withColumn("w", F.lit(2)).cache()
    every = [
        Linear.build(df, "k", shape=Shape(3, 64)), Tally.build(df, "k", "w", shape=Shape(3, 64)), HLL.build(df, "k"), DDSketch.build(df, "k"), KLL.build(df, "k"), Coco.build(df, "k", 2, 64),
        heavy.elastic(df, "k", "i", 4), UnivMon.build(df, "k", pyramid=Pyramid(3, 20, 3, 64, 64)), Hydra.build(df, F.concat(F.lit("k="), F.col("k") % 3), "k", kind="hll", big=True),
        Hybrid.build(df, "k", limit=10, pyramid=Pyramid(3, 20, 3, 64, 64)), Tracked.build(df, "k", k=10),
        HLL.build(windows.assigned(df, "i", k=4, window=200), "k", windows.BUCKET),
    ]
    tables_of = lambda x: {n: v if isinstance(v, DataFrame) else tables_of(v) for n, v in vars(x).items() if isinstance(v, DataFrame) or type(v).__name__ in tables.SKETCHES}
    rows = lambda t: {n: sorted(map(str, v.collect())) if isinstance(v, DataFrame) else rows(v) for n, v in t.items()}
    rest = lambda x: {n: v for n, v in vars(x).items() if not isinstance(v, DataFrame) and type(v).__name__ not in tables.SKETCHES}
    for i, sketch in enumerate(every):
        tables.save(sketch, str(tmp_path / str(i)))
        back = tables.load(spark, str(tmp_path / str(i)))
        assert type(back) is type(sketch) and rest(back) == rest(sketch) and rows(tables_of(back)) == rows(tables_of(sketch))
    with pytest.raises(TypeError):
        tables.save(df, str(tmp_path / "no"))


def test_streams_of_folders(spark, tmp_path):
    """A table of part files, one to a micro-batch; an empty table; a table that is not there."""
    from cellmesh.streaming import stateful

    events = spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), (F.col("id") % 2).cast("string").alias("kind"))
    events.repartitionByRange(5, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    events.limit(0).write.parquet(f"{tmp_path}/none.parquet")
    shape = Shape(2, 16)
    sent = stateful.drained(stateful.thresholded(tables.stream(spark, str(tmp_path), "events", 1), "user_id", 9, shape))
    exact = {(r.row, r.col): r.v for r in Linear.build(events, "user_id", shape=shape).cells.collect()}
    assert {(r.row, r.col): r.v for r in sent.groupBy("row", "col").agg(F.sum("d").alias("v")).collect()} == {k: v - v % 9 for k, v in exact.items()}
    last = stateful.latest(stateful.drained(stateful.sliding_counts(tables.stream(spark, str(tmp_path), "events", 1), "kind", "event_id", 10, 100_000), "update"))
    assert {r.series: r.n for r in last.groupBy("series").agg(F.sum("size").alias("n")).collect()} == {"0": 500, "1": 500}
    counted = stateful.drained(tables.stream(spark, str(tmp_path), "events", 1).groupBy("kind").count(), "complete")
    assert {r.kind: r["count"] for r in counted.collect()} == {"0": 500, "1": 500}
    assert stateful.drained(stateful.thresholded(tables.stream(spark, str(tmp_path), "none"), "user_id", 9, shape)).count() == 0
    assert stateful.drained(stateful.sliding_counts(tables.stream(spark, str(tmp_path), "none"), "kind", "event_id", 10, 100), "update").count() == 0
    with pytest.raises(Exception):
        tables.stream(spark, str(tmp_path), "absent")
