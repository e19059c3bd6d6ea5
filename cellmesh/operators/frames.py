"""What all sketch tables share: parameters, checks, probes."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cell tables of at most so many rows are sent to each task instead of being shuffled: a bound by parameters, not by data.
SENT_CELLS = 1_000_000


class UnsupportedQuery(ValueError):
    """A sketch was asked what it cannot answer."""


class Mismatch(ValueError):
    """Sketches with different parameters cannot be merged."""


def as_list(by: str | Iterable[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def same(*parameters: object) -> None:
    """Raise unless all parameters are equal."""
    if any(p != parameters[0] for p in parameters):
        raise Mismatch(f"parameters differ: {parameters}")


def union(tables: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name; nulls match nulls and each column appears once."""
    right = right.select([F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    match = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    both = left.join(right, match, how) if match else left.crossJoin(right)
    if how in ("full", "outer", "full_outer"):
        both = both.withColumns({c: F.coalesce(F.col(c), F.col(f"_r_{c}")) for c in on})
    return both.drop(*[f"_r_{c}" for c in on])


def top_k(df: DataFrame, k: int, order: str, key: str, by: Iterable[str] = ()) -> DataFrame:
    """The ``k`` rows with the largest ``order`` in each group, ties by ``key``, with their rank ``rk``."""
    from pyspark.sql import Window

    first = [F.col(order).desc(), F.col(key)]
    rank = Window.partitionBy(*by).orderBy(*first)
    if not as_list(by):  # a limit keeps k rows per task before one task ranks them
        return df.orderBy(*first).limit(k).withColumn("rk", F.row_number().over(rank))
    return df.withColumn("rk", F.row_number().over(rank)).where(F.col("rk") <= k)


def dealt(df: DataFrame, key: str, size: int, part: str = "_deal") -> DataFrame:
    """``df`` with the part of its key, by hash: as many parts as leave each some ``size / 2`` distinct keys, so that state for ``size`` holds all of them."""
    parts = df.agg((F.approx_count_distinct(key) * 2 / size).cast("bigint").alias("_parts"))
    return df.crossJoin(F.broadcast(parts)).withColumn(part, F.expr(f"cast(pmod(xxhash64(`{key}`), _parts + 1) AS int)")).drop("_parts")


def dense(cells: DataFrame) -> DataFrame:
    """One row ``_cells``: the array of the values ``v`` by their place ``at``, with 0 where there is none.

    For tables that parameters bound: probes look values up in it, without a shuffle.
    """
    packed = cells.agg(F.expr("sort_array(collect_list(named_struct('at', cast(at as int), 'v', cast(v as double)))) AS p"))
    return packed.selectExpr("flatten(transform(p, (e, i) -> concat(array_repeat(0D, e.at - if(i = 0, -1, get(p, i - 1).at) - 1), array(e.v)))) AS _cells")


def looked_up(at: str) -> str:
    """SQL of the value at a place of :func:`dense`."""
    return f"coalesce(get(_cells, {at}), 0D)"


def median_of(values: list[str]) -> str:
    """SQL of the median of expressions, none null: the mean of the middle two of an even number."""
    n, half = len(values), f"sort_array(array({', '.join(values)}))"
    return f"{half}[{n // 2}]" if n % 2 else f"(({half}[{n // 2 - 1}] + {half}[{n // 2}]) / 2)"


def middle(array: Column, n: int) -> Column:
    """The median of an array of ``n`` numbers."""
    half = F.sort_array(array)
    return half[n // 2] if n % 2 else (half[n // 2 - 1] + half[n // 2]) / 2


def present(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])


def rounds(df: DataFrame, fan_in: int) -> int:
    """Levels of a reduction tree in which ``fan_in`` states of tasks over ``df`` become one, until one is left.

    Tasks of a plan without a shuffle are counted; of others they are at most the shuffle's partitions, or one for each piece of the input.
    """
    spark, run = df.sparkSession, df._jdf.queryExecution()
    plan = run.executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        pieces = int(str(run.optimizedPlan().stats().sizeInBytes())) >> 27
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, min(pieces, 1 << 20))
    else:
        parts = plan.execute().getNumPartitions()
    levels = 1
    while parts > fan_in:
        parts, levels = -(-parts // fan_in), levels + 1
    return levels
