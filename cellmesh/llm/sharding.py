"""Sharding by jump consistent hashing, with Spark expressions alone.

A key's shard follows from the key and the number of shards, without a ring table.  One more shard takes rows
only into itself, a share of 1 in ``shards + 1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the multiplier of the 64-bit congruential generator of jump consistent hashing.
STEP = 2862933555777941757
#: A 64-bit word is held as limbs of 22, 22 and 20 bits, so that products and their sums stay below 2^63.
LIMB = 22
#: Jumps after which only a key in some 10^9 of 40 shards goes on; these take as many as they need.
FIRST = 24
#: Parts of a shard that are numbered alone, at every size of the table: hex digits of a digest.
DIGITS = 3


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def _walk(start: Column, shards: int, steps: int) -> Column:
    """At most ``steps`` jumps from a state ``(k0, k1, k2, b, j)``: of those below ``shards``, b is the last, and j the first beyond."""
    s0, s1, s2 = (F.lit(STEP >> i * LIMB & (1 << LIMB) - 1) for i in range(3))

    def step(a: Column, _: Column) -> Column:
        t0 = a["k0"] * s0 + 1
        t1 = a["k0"] * s1 + a["k1"] * s0 + F.shiftright(t0, LIMB)
        t2 = a["k0"] * s2 + a["k1"] * s1 + a["k2"] * s0 + F.shiftright(t1, LIMB)
        moved = F.struct(_low(t0, LIMB).alias("k0"), _low(t1, LIMB).alias("k1"), _low(t2, 64 - 2 * LIMB).alias("k2"), a["j"].alias("b"), a["j"].alias("j"))
        high = lambda m: F.shiftleft(m["k2"], 11) + F.shiftright(m["k1"], 11)  # noqa: E731  the upper 31 bits
        jump = lambda m: F.floor((m["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high(m) + 1).cast("double"))).cast("long")
        landed = F.transform(F.array(moved), lambda m: F.struct(m["k0"].alias("k0"), m["k1"].alias("k1"), m["k2"].alias("k2"), m["b"].alias("b"), jump(m).alias("j")))
        return F.when(a["j"] >= shards, a).otherwise(F.get(landed, F.lit(0)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def jumps(key: Column, shards: int) -> Column:
    """``struct<shard, grown>``: the shards of a bigint key among ``shards`` and among one more; a null key counts as 0.

    Each jump leads at least one further, so ``shards`` jumps end every walk; nearly all end within ``FIRST``.
    """
    k = F.coalesce(key, F.lit(0)).cast("long")
    limbs = [_low(k, LIMB), _low(F.shiftrightunsigned(k, LIMB), LIMB), F.shiftrightunsigned(k, 2 * LIMB)]
    zero = F.lit(0).cast("long")
    start = F.struct(*(x.alias(f"k{i}") for i, x in enumerate(limbs)), zero.alias("b"), zero.alias("j"))
    ends = F.array(_walk(start, shards, min(shards, FIRST)))
    if shards > FIRST:
        ends = F.transform(ends, lambda e: F.when(e["j"] >= shards, e).otherwise(_walk(e, shards, shards)))
    out = F.transform(ends, lambda e: F.struct(e["b"].cast("int").alias("shard"), F.when(e["j"] == shards, e["j"]).otherwise(e["b"]).cast("int").alias("grown")))
    return F.get(out, F.lit(0))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard in ``0 .. shards - 1`` of a bigint key."""
    return jumps(key, shards)["shard"]


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard``, one row per document.

    With ``keep`` the other columns of ``docs`` stand before them; one with a name of these is kept as ``<name>_in``.

    ``size`` is the text's UTF-8 length (null: 0) plus 16.  ``slot`` numbers a shard's rows from 0 without gaps, in the order of the
    first ``DIGITS`` hex digits of the MD5 of ``doc_id:crc:size``, then id (null first), crc and size: one law at every size.
    Rows of equal digits are numbered alone and shifted by the rows before them, so no task sorts a whole shard.
    A null id counts as key 0.  Repeated rows get slots of their own, next to each other.  An empty table gives no rows.
    """
    own = ["doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"]
    others = {c: c for c in docs.columns if c != doc_id} if keep else {}
    for c in others:
        while others[c] in own or (others[c] != c and others[c] in docs.columns):
            others[c] += "_in"
    carried = [F.struct(*(F.col(c).alias(name) for c, name in others.items())).alias("row")] if others else []  # in a struct, so that names never clash
    placed = docs.select(
        *carried,
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        jumps(F.col(doc_id), shards).alias("place"),
    )
    placed = placed.withColumns({"shard": F.col("place.shard"), "grown_shard": F.col("place.grown"), "part": F.substring(F.md5(F.concat_ws(":", "doc_id", "text_crc32", "size").cast("binary")), 1, DIGITS)}).drop("place")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    at = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    # Both sides lie as the window dealt them: only the counts are shuffled.
    numbered = placed.withColumn("at", at).join(shift, ["shard", "part"])
    return numbered.withColumn("slot", (F.col("at") + F.col("shift")).cast("long")).select(*(f"row.{name}" for name in others.values()), *own)
