"""Heavy hitters with bounded state: Space-Saving, Coco and Elastic.

Their state depends on the order of arrival.  Each task folds its own rows in batches; merging folds the states, which
parameters bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from .frames import as_list, dealt, join_null_safe, rounds, same, top_k, union
from .linear import Linear, Shape


def exact_top_k(df: DataFrame, key: str, k: int, weight: str | None = None, by: str | Iterable[str] = ()) -> DataFrame:
    """``(*by, key, cnt, rk)``: the exact cousin, ties by key."""
    by = as_list(by)
    w = F.lit(1) if weight is None else F.col(weight)
    sums = df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.sum(w).alias("cnt"))
    return top_k(sums, k, "cnt", key, by)


# --- one state a group, not too many at a time ---

#: Groups whose states a task holds.
HELD = 1000
#: Keys in a task's Space-Saving tables from which those that are not full are given out.
MOST_KEYS = 1 << 19


class Groups:
    """States of groups in one task.  Beyond ``HELD`` of them the half that saw the fewest rows is given out; states of one group merge later."""

    def __init__(self, make: Callable[[tuple], object]):
        self.make = make
        self.states: dict[tuple, object] = {}
        self.seen: dict[tuple, int] = {}

    def of(self, group: tuple, rows: int) -> object:
        self.seen[group] = self.seen.get(group, 0) + rows
        if group not in self.states:
            self.states[group] = self.make(group)
        return self.states[group]

    def surplus(self) -> list[tuple[tuple, object]]:
        if len(self.states) <= HELD:
            return []
        out = heapq.nsmallest(len(self.states) - HELD // 2, self.states, key=self.seen.__getitem__)
        return [self.pop(g) for g in out]

    def pop(self, group: tuple) -> tuple[tuple, object]:
        self.seen.pop(group)
        return group, self.states.pop(group)


def group_columns(df: DataFrame, by: list[str]) -> str:
    return "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)


def by_group(batch: pd.DataFrame, by: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    if not by:
        yield (), batch
        return
    for key, part in batch.groupby(by, dropna=False, sort=False):
        yield tuple(None if pd.isna(x) else x for x in (key if isinstance(key, tuple) else (key,))), part


def gathered(batches: Iterator[pd.DataFrame], rows: int = 1 << 17) -> Iterator[pd.DataFrame]:
    """Batches of some more rows, in which more keys repeat."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def each_group(df: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` of the rows of each group, which parameters bound: groups stream through a task one after the other, some at a time."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for batch in batches:
            if left is not None:
                batch = pd.concat([left, batch], ignore_index=True)
            if not len(batch):
                continue
            *whole, left = (g for _, g in batch.groupby(keys, dropna=False, sort=False))
            if whole:
                yield pd.concat([f(g) for g in whole])
        if left is not None:
            yield f(left)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(fold, schema)


# --- Space-Saving ---


class Tracked:
    """At most k keys; a new one takes the place of the smallest, whose count becomes its error."""

    def __init__(self, k: int):
        self.k = k
        self.count: dict[str, float] = {}
        self.error: dict[str, float] = {}
        self.heap: list[tuple[float, str]] = []

    def add(self, key: str, w: float, error: float = 0.0) -> None:
        if key in self.count:
            self.count[key] += w
            self.error[key] += error
        elif len(self.count) < self.k:
            self.count[key], self.error[key] = w, error
        else:
            while True:  # entries whose count has moved on go back with the present one
                n, old = heapq.heappop(self.heap)
                if old not in self.count:
                    continue
                if self.count[old] == n:
                    break
                heapq.heappush(self.heap, (self.count[old], old))
            del self.count[old], self.error[old]
            self.count[key], self.error[key] = n + w, n + error
        heapq.heappush(self.heap, (self.count[key], key))
        if len(self.heap) > 8 * self.k + 64:
            self.heap = [(n, x) for x, n in self.count.items()]
            heapq.heapify(self.heap)

    def floor(self) -> float:
        """What a key that is not tracked may weigh at most."""
        return min(self.count.values(), default=0.0) if len(self.count) >= self.k else 0.0


def space_saving(df: DataFrame, key: str, k: int = 100, weight: str | None = None, by: str | Iterable[str] = ()) -> DataFrame:
    """``(*by, key, cnt, err)``: ``cnt - err <= true weight <= cnt``, and every key above W/k is tracked.

    Batches are summed by key first, which keeps both guarantees.  Null keys and weights that are not positive are left out.
    """
    by = as_list(by)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(*by, F.col(key).cast("string").alias("key"), w.alias("w")).where(F.col("key").isNotNull() & (F.col("w") > 0))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, held, given = TaskContext.get().partitionId(), Groups(lambda _: Tracked(k)), 0

        def table(states: Iterable[tuple[tuple, Tracked]]) -> pd.DataFrame:
            out = [(*g, f"{part}-{given}", x, n, t.error[x], t.floor()) for g, t in states for x, n in t.count.items()]
            return pd.DataFrame(out, columns=[*by, "part", "key", "cnt", "err", "floor"])

        for batch in gathered(batches):
            for group, rows in by_group(batch, by):
                state = held.of(group, len(rows))
                for x, n in rows.groupby("key", sort=False)["w"].sum().items():
                    state.add(x, n)
            gone = held.surplus()
            if sum(len(t.count) for t in held.states.values()) > MOST_KEYS:  # a table that is not full has no error to hand on
                gone += [held.pop(g) for g in [g for g, t in held.states.items() if len(t.count) < k]]
            if gone:
                yield table(gone)
                given += 1
        yield table(held.states.items())

    return space_saving_merge(rows.mapInPandas(fold, f"{group_columns(df, by)}part string, key string, cnt double, err double, floor double"), k, by)


def space_saving_all(df: DataFrame, key: str, k: int = 100, weight: str | None = None, by: str | Iterable[str] = ()) -> DataFrame:
    """``(*by, key, cnt, err)`` of every key: keys are dealt by hash into parts that tables of ``k`` keys (256 at least) hold whole.

    No key is evicted, so counts are exact; each task gives out what it holds of the parts, so no state grows with the number of keys.
    """
    k = max(k, 256)
    parts = dealt(df.where(F.col(key).isNotNull()), key, k)
    return space_saving(parts, key, k, weight, [*as_list(by), "_deal"]).drop("_deal")


def space_saving_merge(parts: DataFrame, k: int, by: str | Iterable[str] = ()) -> DataFrame:
    """Merge states ``(*by, part, key, cnt, err, floor)``: a key that a state does not track may have had its floor there.

    One grouped sum: each key's count plus the floors of the states without it; of these the k largest stay.
    """
    by = as_list(by)
    floors = parts.groupBy(*by, "part").agg(F.max("floor").alias("floor")).groupBy(*by).agg(F.sum("floor").alias("every"))
    keys = parts.groupBy(*by, "key").agg(F.sum("cnt").alias("cnt"), F.sum("err").alias("err"), F.sum("floor").alias("own"))
    both = join_null_safe(keys, floors, by) if by else keys.crossJoin(F.broadcast(floors))
    open_ = F.col("every") - F.col("own")
    return top_k(both.select(*by, "key", (F.col("cnt") + open_).alias("cnt"), (F.col("err") + open_).alias("err")), k, "cnt", "key", by).drop("rk")


# --- Coco ---

#: Tasks' tables that become one in a step of the reduction tree.
FAN_IN = 128


@dataclass(frozen=True)
class Coco:
    """``table``: ``(*by, row, col, key, val)``.  Keys stay with their values, so partial keys can be queried."""

    table: DataFrame
    rows: int = 3
    cols: int = 2048
    by: tuple[str, ...] = ()
    seed: int = 0

    @staticmethod
    def build(df: DataFrame, key: str, rows: int = 3, cols: int = 2048, weight: str | None = None, by: str | Iterable[str] = (), seed: int = 0) -> Coco:
        """Each key has one bucket per row; a match is added to, an empty bucket claimed, else the smallest grows and changes owner with
        probability weight / value.  A batch's keys are summed first.  Null and empty keys and weights that are not positive are left out.
        """
        if cols & (cols - 1):
            raise ValueError("columns must be a power of two")
        by = as_list(by)
        w = F.lit(1) if weight is None else F.col(weight)
        text = F.col(key).cast("string")
        items = df.where(text.isNotNull() & (text != "")).select(*by, text.alias("key"), w.cast("bigint").alias("val")).where("val > 0")
        kinds = group_columns(df, by)

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            held = Groups(lambda group: Buckets(rows, cols, (seed, part)))
            table = lambda states: pd.concat([b.frame(by, g).assign(_part=part) for g, b in states] or [_EMPTY.assign(_part=part)])
            for batch in gathered(batches):
                for group, some in by_group(batch, by):
                    state = held.of(group, len(some))
                    for x, n in some.groupby("key", sort=False)["val"].sum().items():
                        state.add(x, int(n))
                if gone := held.surplus():
                    yield table(gone)
            if held.states:
                yield table(held.states.items())

        parts = items.mapInPandas(fold, f"{kinds}row int, col int, key string, val bigint, _part int")
        levels = rounds(items, FAN_IN)
        for level in range(1, levels):
            some = parts.withColumn("_part", F.expr(f"_part div {FAN_IN}").cast("int"))
            parts = _joined(some, [*by, "_part"], rows, cols, seed + 2 + level)
        return Coco(parts.drop("_part"), rows, cols, tuple(by), seed).merge()

    def merge(self, *others: Coco) -> Coco:
        """Equal keys summed, then inserted into one table a group, larger values first.  Tables are bounded by their shape."""
        same((self.rows, self.cols, self.by), *((o.rows, o.cols, o.by) for o in others))
        tables = union([o.table.select(*self.by, "row", "col", "key", "val") for o in (self, *others)])
        return replace(self, table=_joined(tables, list(self.by), self.rows, self.cols, self.seed + 2).select(*self.by, "row", "col", "key", "val"))

    def estimate(self, match: Column | str | None = None) -> DataFrame:
        """``(*by, key, estimate)``: bucket sums of each key, of those that satisfy ``match`` (a condition on ``key``) only."""
        rows = self.table if match is None else self.table.where(match)
        return rows.groupBy(*self.by, "key").agg(F.sum("val").alias("estimate"))

    def partial(self, match: Column | str) -> DataFrame:
        """``(*by, estimate)``: the sum over all keys that satisfy a condition, such as sharing a part."""
        return self.table.where(match).groupBy(*self.by).agg(F.coalesce(F.sum("val"), F.lit(0)).alias("estimate"))


    def partials(
        self, probes: DataFrame, partial: str, match: Callable[[pd.Series, pd.Series], pd.Series], parts: Callable[[Column], Column], part_of: Callable[[Column], Column] = lambda p: p
    ) -> DataFrame:
        """``(*by, partial, estimate)``: for each distinct probe the sum over all keys for which ``match(full, partial)`` holds, 0 where there is none.

        ``match`` takes two series of strings, the full keys and the partial ones, and returns booleans.  ``parts`` lists the parts of a full key under
        which it can be found, ``part_of`` the part that a partial key asks for: only pairs that meet there are matched.  Probes carry the
        group columns; a null partial key or part matches nothing.
        """
        by = list(self.by)
        wanted = probes.select(*by, F.col(partial).cast("string").alias("_partial")).where(F.col("_partial").isNotNull()).distinct()
        keys = self.table.groupBy(*by, "key").agg(F.sum("val").alias("val"))
        listed = keys.select(*by, "key", "val", F.explode(F.array_distinct(parts(F.col("key")))).alias("_part"))
        asked = wanted.withColumn("_part", part_of(F.col("_partial")))
        met = join_null_safe(asked.where(F.col("_part").isNotNull()), listed.where(F.col("_part").isNotNull()), [*by, "_part"])

        @F.pandas_udf("boolean")
        def holds(full: pd.Series, some: pd.Series) -> pd.Series:
            return match(full, some).fillna(False).astype(bool)

        sums = met.where(holds("key", "_partial")).groupBy(*by, "_partial").agg(F.sum("val").alias("estimate"))
        found = join_null_safe(wanted, sums, [*by, "_partial"], "left")
        return found.select(*by, F.col("_partial").alias(partial), F.coalesce("estimate", F.lit(0)).cast("bigint").alias("estimate"))


_EMPTY = pd.DataFrame({"row": pd.Series(dtype="int32"), "col": pd.Series(dtype="int32"), "key": pd.Series(dtype=object), "val": pd.Series(dtype="int64")})


class Buckets:
    """Coco's buckets ``(row, col) -> [key, value]`` in one process."""

    def __init__(self, rows: int, cols: int, seed: object):
        self.rows, self.cols = rows, cols
        self.coin = np.random.default_rng(seed)
        self.held: dict[tuple[int, int], list] = {}

    def add(self, key: str, v: int) -> None:
        spots = list(enumerate(hashing.md5_columns(key, self.rows, self.cols)))
        owned = [s for s in spots if s in self.held]
        mine = next((s for s in owned if self.held[s][0] == key), None)
        if mine is not None:
            self.held[mine][1] += v
        elif len(owned) < len(spots):
            self.held[next(s for s in spots if s not in self.held)] = [key, v]
        else:
            least = self.held[min(spots, key=lambda s: self.held[s][1])]
            least[1] += v
            if self.coin.random() * least[1] < v:
                least[0] = key

    def frame(self, by: list[str], group: tuple) -> pd.DataFrame:
        out = pd.DataFrame([(r, c, k, v) for (r, c), (k, v) in self.held.items()], columns=["row", "col", "key", "val"])
        for name, x in zip(by, group, strict=True):
            out[name] = x
        return out


def _joined(tables: DataFrame, by: list[str], rows: int, cols: int, seed: int) -> DataFrame:
    def join(table: pd.DataFrame) -> pd.DataFrame:
        sums = table.groupby("key")["val"].sum().reset_index().sort_values(["val", "key"], ascending=[False, True])
        state = Buckets(rows, cols, seed)
        for key, v in zip(sums["key"], sums["val"], strict=True):
            state.add(key, int(v))
        return state.frame(by, tuple(table[b].iloc[0] for b in by))[[*by, "row", "col", "key", "val"]]

    given = tables if by else tables.withColumn("_one", F.lit(0))
    return each_group(given, by or ["_one"], join, f"{group_columns(given, by)}row int, col int, key string, val bigint")


# --- Elastic ---

#: A bucket's owner goes when the votes against it reach so many times its own.
VOTES = 8
LIGHT = Shape(5, 2048)


@dataclass(frozen=True)
class Elastic:
    """``heavy``: ``(bucket, flow, vote_pos, vote_neg, mixed)``; ``light``: a Count-Min of what is not heavy.

    ``mixed``: a part of the owner's items may be in the light part.
    """

    heavy: DataFrame
    light: Linear
    buckets: int


class Vote:
    """The owner of one bucket, and what its contest sends to the light part."""

    def __init__(self) -> None:
        self.flow: str | None = None
        self.pos = self.neg = 0
        self.mixed = False
        self.light: dict[str, int] = {}

    def to_light(self, flow: str, n: int) -> None:
        if n:
            self.light[flow] = self.light.get(flow, 0) + n

    def run(self, flow: str, n: int) -> None:
        """``n`` items of one flow in a row.

        A challenger's items go to the light part until the one that outvotes the owner; it takes over with the rest.
        """
        if self.flow is None:
            self.flow = flow
        if self.flow == flow:
            self.pos += n
            return
        lost = max(1, VOTES * self.pos - self.neg)
        if n < lost:
            self.neg += n
            self.to_light(flow, n)
            return
        self.to_light(flow, lost - 1)
        self.to_light(self.flow, self.pos)
        self.flow, self.pos, self.neg, self.mixed = flow, n - lost + 1, 1, True

    def later(self, flow: str, pos: int, neg: int, mixed: bool) -> None:
        """The outcome of the next time range, as a run of its owner's votes; votes against count on where the owner stays."""
        if self.flow in (None, flow):
            self.run(flow, pos)
            self.neg += neg
            self.mixed |= mixed
        else:
            self.run(flow, pos)
            self.mixed = True


def elastic(df: DataFrame, key: str, order: str, buckets: int = 64, every: int = 1 << 20) -> Elastic:
    """Each bucket's keys vote in the order of arrival, within each range of ``every`` ticks of ``order``; ranges' outcomes merge in order.

    A range's bucket streams through one fold, sorted by the shuffle; runs of one key are combined.  No task holds a bucket's
    whole stream, and of all ranges only the outcomes meet in one place.  Null and empty keys are left out, items of equal order go by key.
    """
    text = F.col(key).cast("string")
    hi, _ = hashing.words(F.col(key))
    items = df.where(text.isNotNull() & (text != "")).select((hi % buckets).cast("int").alias("bucket"), text.alias("flow"), F.col(order).alias("o"))
    items = items.withColumn("span", F.floor(F.col("o").cast("double") / every).cast("bigint"))
    kinds = "span bigint, bucket int, flow string, vote_pos bigint, vote_neg bigint, mixed boolean"
    names = ["span", "bucket", "flow", "vote_pos", "vote_neg", "mixed"]

    def table(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"span": "Int64", "bucket": "Int32", "vote_pos": "Int64", "vote_neg": "Int64", "mixed": "boolean"})

    def outcome(here: tuple, v: Vote) -> list[tuple]:
        return [(*here, v.flow, v.pos, v.neg, v.mixed), *((None, None, f, n, None, None) for f, n in v.light.items())]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, vote = None, Vote()
        for batch in batches:
            span, bucket, flow = (batch[c].to_numpy() for c in ("span", "bucket", "flow"))
            change = (span[1:] != span[:-1]) | (bucket[1:] != bucket[:-1]) | (flow[1:] != flow[:-1])
            starts = [0, *(np.flatnonzero(change) + 1).tolist()] if len(batch) else []
            rows: list[tuple] = []
            for a, b in zip(starts, [*starts[1:], len(batch)], strict=False):
                if (span[a], bucket[a]) != here:
                    if here is not None:
                        rows += outcome(here, vote)
                    here, vote = (span[a], bucket[a]), Vote()
                vote.run(flow[a], b - a)
                if len(vote.light) > 100_000:
                    rows += [(None, None, f, n, None, None) for f, n in vote.light.items()]
                    vote.light = {}
            if rows:
                yield table(rows)
        if here is not None:
            yield table(outcome(here, vote))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        vote = Vote()
        for r in rows.sort_values("span").itertuples():
            vote.later(r.flow, int(r.vote_pos), int(r.vote_neg), bool(r.mixed))
        bucket = int(rows["bucket"].iloc[0])
        return table([(None, *x[1:]) if x[1] is not None else x for x in outcome((None, bucket), vote)])

    voted = items.repartition("span", "bucket").sortWithinPartitions("span", "bucket", "o", "flow").mapInPandas(fold, kinds)
    merged = each_group(voted.where("bucket is not null"), ["bucket"], merge, kinds)
    light = voted.where("bucket is null").unionByName(merged.where("bucket is null"))
    return Elastic(merged.where("bucket is not null").drop("span"), Linear.build(light, "flow", "vote_pos", shape=LIGHT), buckets)


def elastic_query(sketch: Elastic, probes: DataFrame, key: str) -> DataFrame:
    """``(key, estimate)``: an owner's votes, with the light estimate if a part of it is there; others the light estimate."""
    light = sketch.light.estimate(probes.select(F.col(key).cast("string").alias(key)), key)
    owned = light.join(sketch.heavy, F.col(key) == F.col("flow"), "left")
    value = F.when(F.col("flow").isNull(), F.col("estimate")).otherwise(F.col("vote_pos") + F.when(F.col("mixed"), F.col("estimate")).otherwise(0))
    return owned.select(key, value.cast("bigint").alias("estimate"))


def elastic_merge(*sketches: Elastic) -> Linear:
    """All heavy parts flushed into the light ones: a Count-Min of the union."""
    same(*(s.buckets for s in sketches))
    flushed = [Linear.build(s.heavy, "flow", "vote_pos", shape=LIGHT) for s in sketches]
    return sketches[0].light.merge(*(s.light for s in sketches[1:]), *flushed)
