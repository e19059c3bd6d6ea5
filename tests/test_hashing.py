import pytest
import xxhash
from pyspark.sql import functions as F

from cellmesh.functions import hashing
from cellmesh.operators import hll, sampling

KEY = b"a stream key"


def test_xxh3_seeds():
    assert xxhash.xxh3_64_intdigest(b"") == 0x2D06800538D394C2  # the published value of no input
    assert hashing.xxh3_64(KEY, 0) == xxhash.xxh3_64_intdigest(KEY, seed=0xCAFE3553)
    assert hashing.xxh3_64(KEY, 5) == xxhash.xxh3_64_intdigest(KEY, seed=0x6A09E667)
    lo, hi = hashing.xxh3_128(KEY, 5)
    assert hi << 64 | lo == xxhash.xxh3_128_intdigest(KEY, seed=0x6A09E667)


def test_seed_indexes_wrap():
    assert hashing.seed(20) == hashing.seed(0) and hashing.seed(-1) == hashing.seed(19)
    assert len(set(hashing.SEEDS)) == 20


def test_udfs_agree(spark):
    df = spark.createDataFrame([(KEY.decode(),), (None,)], "k string")
    rows = df.select(hashing.hash64()("k").alias("a"), hashing.hash_it(5)("k").alias("b"), hashing.hash128_it(5)("k").alias("c")).collect()
    assert rows[0]["a"] == hashing.signed(hashing.xxh3_64(KEY, 0)) and rows[0]["b"] == hashing.signed(hashing.xxh3_64(KEY, 5))
    assert rows[0]["c"]["lo"] == hashing.signed(hashing.xxh3_128(KEY, 5)[0])
    assert rows[1]["a"] is None


@pytest.mark.parametrize(("rows", "cols", "mode"), [(5, 2048, "packed64"), (5, 4096, "packed128"), (3, 4096, "packed64"), (16, 4096, "rows")])
def test_hash_mode(rows, cols, mode):
    assert hashing.hash_mode(rows, cols) == mode


def test_slices(spark):
    h = 0xFEDCBA9876543210
    row = spark.range(1).select(*[hashing.derive_index(F.lit(hashing.signed(h)), r, 2048).alias(f"i{r}") for r in range(5)], *[hashing.derive_sign(F.lit(hashing.signed(h)), r).alias(f"s{r}") for r in range(5)]).first()
    assert [row[f"i{r}"] for r in range(5)] == [(h >> 11 * r) & 2047 for r in range(5)]
    assert [row[f"s{r}"] for r in range(5)] == [1 if (h >> (63 - r)) & 1 else -1 for r in range(5)]
    with pytest.raises(ValueError):
        hashing.derive_index(F.lit(0), 0, 2000)


def test_hll_register_vectors():
    steps = {0x0002000000000000: (0, 1), 0x0: (0, 51), 0xFFFC300000000000: (16383, 5), 0xCAFE000000000000: (12991, 1), 0xCAFC00CECAFEFACE: (12991, 11)}
    steps |= {0xFACECAFEFACECAFE: (16051, 1), 0xFACCCA000000CAFE: (16051, 3), 0x0831831000000000: (524, 2), 0x3014159265358000: (3077, 6), 0xCAFC0ACECAFEFACE: (12991, 11)}
    registers = {}
    for h, (reg, value) in steps.items():
        r, rho = hll.register_of(h)
        registers[r] = max(registers.get(r, 0), rho)
        assert (r, registers[r]) == (reg, value), hex(h)
    assert 1000 not in registers


@pytest.mark.parametrize("shape", [(3, 17), (3, 64), (8, 2048), (20, 4096)])
def test_columns_of_profiles_stay_in_range(spark, shape):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    for profile in hashing.PROFILES:
        words = hashing.words_of(F.col("k"), *shape, profile)
        held = df.withColumns({f"h{i}": w for i, w in enumerate(words)})
        h = [f"h{i}" for i in range(len(words))]
        for row in (0, shape[0] - 1):
            rows = held.selectExpr(f"{hashing.column_sql(h, row, *shape)} AS c", f"{hashing.sign_sql(h, row, *shape)} AS s").collect()
            cols, signs = [r.c for r in rows], [r.s for r in rows]
            assert 0 <= min(cols) and max(cols) < shape[1] and len(set(cols)) > 0.55 * min(500, shape[1])
            assert set(signs) == {1, -1} and abs(sum(signs)) < 120


def test_binary_keys_and_repeats(spark):
    df = spark.createDataFrame([(b"ab",), (b"ab",), (None,), (b"c",)], "k binary")
    got = [r.h for r in df.select(hashing.hash_it(3)("k").alias("h")).collect()]
    one = lambda k: hashing.signed(hashing.xxh3_64(k, 3))
    assert got == [one(b"ab"), one(b"ab"), None, one(b"c")]


def test_threshold_sampling_is_stable():
    kept = [sampling.keep_by_hash(hashing.xxh3_64(str(i).encode(), 5), 0.1) for i in range(20000)]
    assert abs(sum(kept) / 20000 - 0.1) < 0.01
    assert sampling.keep_by_hash(1, 1.0) and not sampling.keep_by_hash(1, 0.0)
