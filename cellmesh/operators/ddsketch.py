"""DDSketch as a table of buckets ``(*by, bucket, cnt)``: relative-error quantiles of positive values."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import UnsupportedQuery, as_list, join_null_safe, same, union


@dataclass(frozen=True)
class Mapping:
    """Bucket k holds values from gamma^k up to gamma^(k+1); gamma^k (1 + alpha) stands for them."""

    alpha: float = 0.01

    def __post_init__(self) -> None:
        if not 0 < self.alpha < 1:
            raise ValueError("alpha lies between 0 and 1")

    @property
    def gamma(self) -> float:
        return (1 + self.alpha) / (1 - self.alpha)

    @property
    def per_log(self) -> float:
        return 1 / math.log(self.gamma)

    @property
    def bounds(self) -> tuple[float, float]:
        """Values whose bucket number fits 32 bits and whose representative is finite and normal."""
        least = max(math.exp((-(2.0**31) + 1) / self.per_log) if self.per_log > 3 else 0.0, 2.2250738585072014e-308 * self.gamma)
        return least, 1.7976931348623157e308 / self.gamma / (1 + self.alpha)

    def bucket(self, v: Column) -> Column:
        return F.floor(F.log(v) * self.per_log).cast("int")

    def value(self, bucket: Column) -> Column:
        return F.exp(bucket / self.per_log) * (1 + self.alpha)

    def indexable(self, v: Column) -> Column:
        """Zeros, negative values, NaN, infinite and extreme values are not."""
        least, most = self.bounds
        return v.isNotNull() & ~F.isnan(v) & (v >= least) & (v <= most)


@dataclass(frozen=True)
class DDSketch:
    """``buckets``: ``(*by, bucket, cnt)``.  ``summary``: ``(*by, count, sum, min, max, dropped)``."""

    buckets: DataFrame
    summary: DataFrame
    mapping: Mapping = Mapping()
    by: tuple[str, ...] = ()
    sample_p: float = 1.0

    @staticmethod
    def build(df: DataFrame, value: str, by: str | Iterable[str] = (), alpha: float = 0.01, sample_p: float = 1.0) -> DDSketch:
        """Values that cannot be indexed are dropped and counted.  ``df`` is what was admitted at ``sample_p``."""
        by, mapping = as_list(by), Mapping(alpha)
        v = F.col(value).cast("double")
        ok = mapping.indexable(v)
        buckets = df.where(ok).groupBy(*by, mapping.bucket(v).alias("bucket")).agg(F.count("*").alias("cnt"))
        kept = F.when(ok, v)
        summary = df.groupBy(*by).agg(
            F.count(kept).alias("count"), F.sum(kept).alias("sum"), F.min(kept).alias("min"), F.max(kept).alias("max"), (F.count(v) - F.count(kept)).alias("dropped")
        )
        return DDSketch(buckets, summary, mapping, tuple(by), sample_p)

    @staticmethod
    def from_buckets(buckets: DataFrame, by: str | Iterable[str] = (), alpha: float = 0.01) -> DDSketch:
        """A sketch of buckets alone: count from them, least and largest value from their representatives, no sum."""
        by, mapping = as_list(by), Mapping(alpha)
        ends = buckets.where("cnt > 0").groupBy(*by).agg(F.sum("cnt").alias("count"), F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
        summary = ends.select(
            *by, "count", F.lit(None).cast("double").alias("sum"), mapping.value(F.col("lo")).alias("min"), mapping.value(F.col("hi")).alias("max"), F.lit(0).cast("bigint").alias("dropped")
        )
        return DDSketch(buckets, summary, mapping, tuple(by))

    def _summed(self, buckets: DataFrame) -> DataFrame:
        return buckets.groupBy(*self.by, "bucket").agg(F.sum("cnt").alias("cnt"))

    def merge(self, *others: DDSketch) -> DDSketch:
        for o in others:
            if abs(o.mapping.gamma - self.mapping.gamma) > 1e-15:
                same(self.mapping, o.mapping)
        same((self.by, self.sample_p), *((o.by, o.sample_p) for o in others))
        every = [self, *others]
        summary = union([o.summary for o in every]).groupBy(*self.by)
        summary = summary.agg(*[f(c).alias(c) for c, f in (("count", F.sum), ("sum", F.sum), ("min", F.min), ("max", F.max), ("dropped", F.sum))])
        return replace(self, buckets=self._summed(union([o.buckets for o in every])), summary=summary)

    def max_bins(self, n: int) -> DDSketch:
        """At most ``n`` bins: lower buckets go into the lowest that stays.  Counts and high quantiles stay."""
        floor = F.max("bucket").over(Window.partitionBy(*self.by)) - (n - 1) if self.by else None
        if floor is None:
            top = self.buckets.agg((F.max("bucket") - (n - 1)).alias("floor"))
            moved = self.buckets.crossJoin(F.broadcast(top)).withColumn("bucket", F.greatest("bucket", "floor")).drop("floor")
        else:
            moved = self.buckets.withColumn("bucket", F.greatest(F.col("bucket"), floor))
        return replace(self, buckets=self._summed(moved))

    def quantiles(self, qs: Iterable[float]) -> DataFrame:
        """``(*by, q, value)``: rank ``ceil(q n)`` walks the buckets; 0 is the least value, 1 the representative of the top bucket."""
        qs = [float(q) for q in qs]
        if any(not 0 <= q <= 1 for q in qs):
            raise UnsupportedQuery("quantiles lie between 0 and 1")
        by = list(self.by)
        run = Window.partitionBy(*by).orderBy("bucket")
        walked = self.buckets.where("cnt > 0").select(*by, "bucket", F.sum("cnt").over(run).alias("seen"))
        table = walked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bucket", "seen"))).alias("walk"))  # as many as buckets
        both = join_null_safe(table, self.summary, by, "inner") if by else table.crossJoin(F.broadcast(self.summary))
        both = both.withColumn("q", F.explode(F.array(*map(F.lit, qs))))
        rank = F.ceil(F.col("q") * F.element_at("walk", -1)["seen"])
        hit = F.get(F.filter("walk", lambda w: w["seen"] >= rank), F.lit(0))["bucket"]
        top = self.mapping.value(F.element_at("walk", -1)["bucket"])
        value = F.when(F.col("q") == 0, F.col("min")).when(F.col("q") == 1, top).otherwise(F.least(F.greatest(self.mapping.value(hit), F.col("min")), top))
        return both.select(*by, "q", value.alias("value"))

    def count(self) -> DataFrame:
        """``(*by, count)``, scaled if values were sampled."""
        return self.summary.select(*self.by, (F.col("count") / self.sample_p).alias("count") if self.sample_p < 1 else F.col("count"))

    def delta(self, before: DDSketch, threshold: int = 1) -> DataFrame:
        """``(*by, bucket, d)``: buckets that grew by ``threshold`` or more."""
        same((self.mapping, self.by), (before.mapping, before.by))
        both = self.buckets.unionByName(before.buckets.withColumn("cnt", -F.col("cnt")))
        return self._summed(both).withColumnRenamed("cnt", "d").where(F.col("d") >= max(1, threshold))

    def apply(self, *deltas: DataFrame) -> DDSketch:
        """Add deltas.  Least and largest values follow from representatives; a sum cannot be told."""
        buckets = self._summed(union([self.buckets, *(d.withColumnRenamed("d", "cnt") for d in deltas)]))
        fresh = DDSketch.from_buckets(buckets, self.by, self.mapping.alpha)
        return replace(self, buckets=buckets, summary=fresh.summary)

    # --- buckets ---

    def at(self, probes: DataFrame, value: str) -> DataFrame:
        """``(*by, value, bucket, lower, representative, cnt)`` of each distinct probe that has a bucket."""
        v = F.col(value).cast("double")
        wanted = probes.select(*self.by, v.alias(value)).where(self.mapping.indexable(F.col(value))).distinct().withColumn("bucket", self.mapping.bucket(F.col(value)))
        found = join_null_safe(wanted, self.buckets, [*self.by, "bucket"], "left")
        lower = F.exp(F.col("bucket") / self.mapping.per_log)
        return found.select(*self.by, value, "bucket", lower.alias("lower"), self.mapping.value(F.col("bucket")).alias("representative"), F.coalesce("cnt", F.lit(0)).alias("cnt"))

    def populated(self) -> DataFrame:
        """``(*by, populated)``: how many buckets hold something."""
        return self.buckets.where("cnt > 0").groupBy(*self.by).agg(F.count("*").alias("populated"))

    def drain(self, least: int = 1) -> tuple[DataFrame, DDSketch]:
        """The buckets that hold ``least`` or more, and the sketch of the others alone."""
        rest = self.buckets.where(F.col("cnt") < least)
        return self.buckets.where(F.col("cnt") >= least), replace(self, buckets=rest, summary=DDSketch.from_buckets(rest, self.by, self.mapping.alpha).summary)


def sampled(df: DataFrame, value: str, item: str, p: float, by: str | Iterable[str] = (), alpha: float = 0.01) -> DDSketch:
    """A sketch of the items admitted at ``p``, which travels with it: counts are scaled when they are asked, quantiles are not."""
    from .sampling import admit

    return DDSketch.build(df.where(admit(F.col(item), p)), value, by, alpha, p)
