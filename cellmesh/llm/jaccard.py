"""Size-aware heavy-light join of word-shingle sets by Jaccard similarity.

Equal sets become one class.  A class with a small set is *light*: it enumerates the subsets of each size that a
partner of each possible size must share with it, and two sets that share a subset meet.  The others are
*heavy*: their rarest shingles form inverted lists, as many of them as any partner must hit one of.  The boundary between
the two is the size at which the modelled cost of enumerating and scanning is least.

Shingles are ordered by a counting sketch over all documents, then by hash.  Any order gives whole results; this one keeps
shared passages out of the lists.  Lists of shingles that the sketch counts often are dealt into blocks, and blocks meet in
pairs, so no task holds an unbounded list.

Lists are not expanded into all pairs.  First, each distinct list's stars are checked exactly and linked: its most
central document with all others, and neighbours by size.  Only members that are then still in different components are paired, and checked exactly too.  A pair is left out where
its sets cannot be similar: by their sizes, or by the places of the shingle at which they meet.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ids
from .components import components
from .shared import batch_rows, map_file, new_folder, scratch, stash, write_file
from .text import NON_SPACE, U64, buffers, chunks, keys, mix, release, shingle_sets, words

#: Cells of the counting sketch, and pieces in which tasks send it.
CELLS, PIECES = 1 << 20, 64
#: Sizes that may be light at most; the cost model chooses below.
MOST_LIGHT = 20
#: Ranges of lists for each shuffle partition: a task holds one at a time.
SPLIT = 8
#: Entries of a list beyond which it is dealt into blocks.
LIST = 20_000
#: Rounds of stars before all remaining pairs are checked.
STARS = 1
#: Place of a list that a subset, not a shingle, stands for.
NO_PLACE = 1 << 31
#: Bits of the filter that tells which documents' sets a check needs.
FILTER = 1 << 23
SALTS = keys(8, 23)


def text_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    h, _, _, off = words(*buffers(column), NON_SPACE)
    return shingle_sets(h, off, k)


def overlap(a: int, b: int, percent: int) -> int:
    """The least common size at which sets of sizes a and b are similar: ``100 o >= percent (a + b - o)``."""
    return -(-percent * (a + b) // (100 + percent))


def subset_sizes(n: int, percent: int) -> list[int]:
    """The sizes of subsets that a set of size n shares with similar sets of every possible size."""
    return sorted({overlap(n, b, percent) for b in range(-(-percent * n // 100), 100 * n // percent + 1)})


def prefix(n: int, percent: int) -> int:
    """How many of the first shingles, in one order for all sets, meet those of every similar set."""
    return n - -(-percent * n // 100) + 1


def light_up_to(histogram: np.ndarray, percent: int, list_length: float = 2.0) -> int:
    """The boundary of least cost: subsets written by sets up to it, against lists scanned and sets read again beyond it."""
    sizes = range(1, MOST_LIGHT + 1)
    light = np.array([0.0] + [sum(math.comb(n, c) for c in subset_sizes(n, percent)) for n in sizes])
    heavy = np.array([0.0] + [prefix(n, percent) * (1 + list_length) + n for n in sizes])
    n = np.zeros(MOST_LIGHT + 1)
    n[: len(histogram)] = histogram[: MOST_LIGHT + 1]
    cost = np.cumsum(n * light) + (n * heavy).sum() - np.cumsum(n * heavy)
    return int(np.argmin(cost))


@lru_cache(maxsize=256)
def _left_out(n: int, r: int) -> np.ndarray:
    """All ways to leave r of n out, one a row."""
    return np.array(list(combinations(range(n), r)), np.int64).reshape(math.comb(n, r), r)


def subset_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """A key for each subset that a light set enumerates: the mixed sum of its shingles, with its size."""
    m = mix(s ^ SALTS[0])
    total = m.sum(dtype=U64)
    out = []
    for c in subset_sizes(len(s), percent):
        if c <= len(s):
            gone = m[_left_out(len(s), len(s) - c)].sum(axis=1, dtype=U64)
            out.append(mix((total - gone) ^ SALTS[1 + c % 4]) + U64(c))
    return np.concatenate(out)


# --- statistics over all documents ---


def count_shingles(docs: DataFrame, k: int) -> tuple[str, np.ndarray]:
    """URI of the counting sketch of all shingles (``CELLS`` 32-bit cells), and the number of sets of each small size.

    Both have a fixed size; tasks send pieces, and each piece is added up in one place.
    """
    width = CELLS // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, sizes = np.zeros(CELLS, np.int64), np.zeros(width, np.int64)
        for batch in chunks(batches):
            sets = text_sets(batch.column(0), k)
            if sets:
                cells += np.bincount((np.concatenate(sets) >> U64(44)).astype(np.int64), minlength=CELLS)
                n = np.array([len(s) for s in sets])
                sizes[: MOST_LIGHT + 1] += np.bincount(n[n <= MOST_LIGHT], minlength=MOST_LIGHT + 1)
        if cells.any():
            parts = [*cells.reshape(PIECES, width), sizes]
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES + 1), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["piece", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(data), np.int64)
                total[piece] = total[piece] + x if piece in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes()) for x in total.values()], pa.binary())], ["piece", "data"])

    schema = "piece int, data binary"
    with batch_rows(docs.sparkSession, 2000):
        parts = docs.select("text").mapInArrow(count, schema).repartition(PIECES + 1, "piece").mapInArrow(add, schema).collect()
    found = {r["piece"]: np.frombuffer(zlib.decompress(r["data"]), np.int64) for r in parts}
    cells = np.concatenate([found.get(i, np.zeros(width, np.int64)) for i in range(PIECES)])
    uri = f"{new_folder(docs.sparkSession, 'shingle-counts')}/cells"
    write_file(uri, np.minimum(cells, (1 << 32) - 1).astype(np.uint32).tobytes())
    return uri, found.get(PIECES, np.zeros(width, np.int64))


# --- sets, classes, lists ---


def sets_of(docs: DataFrame, k: int, percent: int, cells_uri: str, light: int, most: int) -> DataFrame:
    """``doc_id, n_shingles, k1, k2, postings, places``: a document's set by two keys, the keys of the lists that it enters, and the place
    of each list's shingle in the set's order.

    Without words there are no keys.  ``most``: entries of a list before it is dealt into blocks.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(map_file(cells_uri), np.uint32)
        for batch in chunks(batches):
            ns, one, two, posts, places = [], [], [], [], []
            for s in text_sets(batch.column(1), k):
                n = len(s)
                ns.append(n)
                if not n:
                    one.append(None)
                    two.append(None)
                    posts.append(None)
                    places.append(None)
                    continue
                key = mix(s ^ SALTS[5]).sum(dtype=U64)
                one.append(int(key.view(np.int64)))
                two.append(int(mix(s ^ SALTS[6]).sum(dtype=U64).view(np.int64)))
                lists, place = [], []
                if n <= light:
                    lists.append(subset_keys(s, percent))
                    place.append(np.full(len(lists[0]), NO_PLACE, np.uint32))
                if n > light or 100 * n >= percent * (light + 1):
                    often = cells[(s >> U64(44)).astype(np.int64)]
                    first = np.argsort(often, kind="stable")[: prefix(n, percent)]
                    chosen, often = s[first], often[first]
                    hot = often > most
                    lists.append(mix(chosen[~hot] ^ SALTS[7]))
                    place.append(np.flatnonzero(~hot).astype(np.uint32))
                    for i, c in zip(np.flatnonzero(hot).tolist(), often[hot].tolist(), strict=True):
                        blocks = -(-c // most)
                        own = int(key % U64(blocks))
                        other = np.arange(blocks)
                        pair = np.minimum(own, other) * blocks + np.maximum(own, other) + 1
                        lists.append(mix(mix(chosen[i : i + 1] ^ SALTS[7]) + pair.astype(U64)))
                        place.append(np.full(blocks, i, np.uint32))
                posts.append(np.concatenate(lists).tobytes())
                places.append(np.concatenate(place).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(posts, pa.binary()), pa.array(places, pa.binary())],
                ["doc_id", "n_shingles", "k1", "k2", "postings", "places"],
            )

    return docs.mapInArrow(rows, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, postings binary, places binary")


def shared_lists(classes: DataFrame, tasks: int) -> DataFrame:
    """``list, members, sizes, places, order``: the lists with two members at least, by size and id; those of a range with equal members once.

    Keys of lists are cut into ``SPLIT`` ranges for each of ``tasks``; a task gets them sorted.

    Rows without ``list`` say of ``members`` how often each met another at a shingle: in ``sizes``.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            key = np.concatenate([np.frombuffer(p, U64) for _, _, p, _ in held])
            times = [len(p) // 8 for _, _, p, _ in held]
            rep = np.repeat(np.array([r for r, _, _, _ in held], np.int64), times)
            n = np.repeat(np.array([n for _, n, _, _ in held], np.int64), times) << 32 | np.concatenate([np.frombuffer(q, np.uint32) for _, _, _, q in held])
            part = (key >> U64(32)) * U64(parts) >> U64(32)
            order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1).astype(U64))
            data = [np.concatenate([key[o].view(np.int64), rep[o], n[o]]).tobytes() for o in (order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))]
            full = [i for i, d in enumerate(data) if d]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([data[i] for i in full], pa.binary())], ["part", "data"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[2])
                if size > 8 << 20:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        release()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            for part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != here and held:
                    yield from lists_of(held)
                    held = []
                here = part
                held.append(np.frombuffer(data, np.int64).reshape(3, -1))
        if held:
            yield from lists_of(held)

    def lists_of(blocks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate([b[0] for b in blocks])
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        shared = np.zeros(len(key), bool)
        shared[1:] |= same
        shared[:-1] |= same
        key, order = key[shared], order[shared]
        rep, n = np.concatenate([b[1] for b in blocks])[order], np.concatenate([b[2] for b in blocks])[order]
        blocks.clear()
        release()
        if not len(key):
            return
        place, n = n & 0xFFFFFFFF, n >> 32
        order = np.lexsort((rep, n, key))
        key, rep, n, place = key[order], rep[order], n[order], place[order]
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        ends = np.concatenate([starts[1:], [len(key)]])
        who = np.add.reduceat(mix(rep.view(U64)), starts) + (ends - starts).astype(U64)
        # Of lists with equal members the first in the order of shingles stays: at it, pairs of these members meet first.
        early = np.add.reduceat(place, starts)
        by_place = np.lexsort((early, who))
        who = who[by_place]
        new = np.concatenate([[True], who[1:] != who[:-1]])
        who, first = who[new], by_place[new]
        for a in range(0, len(first), 4096):
            some = first[a : a + 4096]
            cut = lambda x: pa.array([x[starts[i] : ends[i]].tobytes() for i in some], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(who[a : a + 4096].view(np.int64)), cut(rep), cut(n), cut(place), pa.array(early[some])], NAMES)
        met, times = np.unique(rep[place < NO_PLACE], return_counts=True)
        for a in range(0, len(met), 65536):
            row = [pa.array([None], pa.int64()), pa.array([met[a : a + 65536].tobytes()]), pa.array([times[a : a + 65536].tobytes()]), pa.array([None], pa.binary()), pa.array([None], pa.int64())]
            yield pa.RecordBatch.from_arrays(row, NAMES)

    parts = SPLIT * tasks
    dealt = classes.select("rep", "n_shingles", "postings", "places").mapInArrow(deal, "part int, data binary").repartition(tasks, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(gather, "list bigint, members binary, sizes binary, places binary, order bigint")


NAMES = ["list", "members", "sizes", "places", "order"]


def distinct_lists(shared: DataFrame) -> DataFrame:
    """Each membership once: its list that comes first in the order of shingles."""
    rows = shared.where("list is not null").groupBy("list").agg(F.min_by(F.struct("members", "sizes", "places"), "order").alias("x"))
    return rows.select("list", "x.members", "x.sizes", "x.places")


def times_met(shared: DataFrame) -> DataFrame:
    """``met_rep, met``: how many of a document's first shingles are in another document's lists too, at most."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                both = [np.concatenate([np.frombuffer(x, np.int64) for x in c.to_pylist()]) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in both], ["met_rep", "met"])

    counts = shared.where("list is null").select("members", "sizes").mapInArrow(rows, "met_rep bigint, met bigint")
    return counts.groupBy("met_rep").agg(F.sum("met").alias("met"))


PAIR = "a bigint, b bigint"


def listed(lists: DataFrame, met: DataFrame) -> DataFrame:
    """``list, rep, n, place, met``: a row for each member of each list."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m, s, p = ([np.frombuffer(x, np.int64) for x in c.to_pylist()] for c in batch.columns[1:4])
            key = np.repeat(batch.column(0).to_numpy(), [len(x) for x in m])
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.concatenate(x)) for x in (m, s, p))], ["list", "rep", "n", "place"])

    rows = lists.mapInArrow(members, "list bigint, rep bigint, n bigint, place bigint")
    return rows.join(met, F.col("rep") == F.col("met_rep"), "left").select("list", "rep", "n", "place", F.coalesce("met", F.lit(0)).alias("met"))


class Members:
    """One list's documents by size, and which two of them can be similar."""

    def __init__(self, percent: int, rep: np.ndarray, n: np.ndarray, place: np.ndarray, met: np.ndarray, label: np.ndarray):
        order = np.lexsort((rep, n))
        self.percent, self.rep, self.n, self.label = percent, rep[order], n[order], label[order]
        place, met, shingle = place[order], met[order], place[order] < NO_PLACE
        # At the first shingle that two sets share, what they share is no more than what is left of each.
        rest = self.n - np.where(shingle, place, 0)
        self.most = rest
        # First shingles that met no other document's first ones: few where a document is near what a group has in common.
        self.alone = np.where(shingle, np.maximum(0, self.n - -(-percent * self.n // 100) + 1 - met), 0)

    def possible(self, i: int, j: np.ndarray | slice) -> np.ndarray:
        o = np.minimum(self.most[j], self.most[i])
        return (100 * o >= self.percent * (self.n[j] + self.n[i] - o)) & (self.rep[j] != self.rep[i])

    def star(self) -> list[np.ndarray]:
        """Of the document that shares most of its set, with each of another component; and of neighbours by size."""
        hub = int(np.argmin(self.alone / self.n))
        j = np.flatnonzero(self.label != self.label[hub])
        j = j[self.possible(hub, j)]
        k = np.flatnonzero(self.label[1:] != self.label[:-1])
        k = np.array([i for i in k.tolist() if self.possible(i, slice(i + 1, i + 2))[0]], np.int64)
        return [np.concatenate([np.full(len(j), self.rep[hub]), self.rep[k]]), np.concatenate([self.rep[j], self.rep[k + 1]])]

    def every(self) -> Iterator[list[np.ndarray]]:
        """All pairs of different components, document by document."""
        end = np.searchsorted(self.n, 100 * self.n // self.percent, "right")
        for i in range(len(self.rep)):
            j = slice(i + 1, end[i])
            found = self.rep[j][(self.label[j] != self.label[i]) & self.possible(i, j)]
            if len(found):
                yield [np.full(len(found), self.rep[i]), found]


def pairs_of(listed: DataFrame, labels: DataFrame | None, percent: int, parts: int, every: bool) -> DataFrame:
    """Distinct pairs of a list's members in different components that can be similar: ``every`` one, or a star of each list."""

    def pairs(x: np.ndarray) -> Iterator[list[np.ndarray]]:
        if (x[-1] == x[-1, 0]).all():
            return
        members = Members(percent, *x[1:])
        if every:
            yield from members.every()
        else:
            yield members.star()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: np.ndarray | None = None  # the last list so far: it may go on
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        for batch in batches:
            x = np.stack([c.to_numpy() for c in batch.columns])
            x = x if left is None else np.concatenate([left, x], axis=1)
            cuts = [0, *(np.flatnonzero(x[0, 1:] != x[0, :-1]) + 1).tolist()]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for p in pairs(x[:, a:b]):
                    held.append(p)
                    size += len(p[0])
                    if size > 500_000:
                        yield flush()
                        held, size = [], 0
            left = x[:, cuts[-1] :]
        if left is not None and left.shape[1]:
            held += pairs(left)
        if held:
            yield flush()

    if labels is None:
        marked = listed.withColumn("label", F.col("rep"))
    else:
        marked = listed.join(labels, F.col("rep") == F.col("node"), "left").select(*listed.columns, F.coalesce("component", "rep").alias("label"))
    return marked.repartition(parts, "list").sortWithinPartitions("list").mapInArrow(rows, PAIR).distinct()


# --- exact checks ---


def id_filter(ids: DataFrame) -> str:
    """URI of a bit table of fixed size: the bit of each id's hash is set.  Tasks send pieces, and each piece is united in one place."""
    width = FILTER // 8 // PIECES

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER, bool)
        for batch in batches:
            bits[(mix(batch.column(0).to_numpy().view(U64)) % U64(FILTER)).astype(np.int64)] = True
        parts = {i: x for i, x in enumerate(np.packbits(bits).reshape(PIECES, width)) if x.any()}
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in parts.values()], pa.binary())], ["piece", "data"])

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(data), np.uint8)
                total[piece] = total[piece] | x if piece in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["piece", "data"])

    schema = "piece int, data binary"
    bits = np.zeros((PIECES, width), np.uint8)
    for r in ids.mapInArrow(rows, schema).repartition(PIECES, "piece").mapInArrow(union, schema).collect():
        bits[r["piece"]] = np.frombuffer(zlib.decompress(r["data"]), np.uint8)
    uri = f"{new_folder(ids.sparkSession, 'ids')}/bits"
    write_file(uri, bits.tobytes())
    return uri


def similar(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar.

    Only documents that a pair may name have their sets sent, once for each side's join.
    """
    uri = id_filter(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(map_file(uri), np.uint8)).view(bool)
        for batch in chunks(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            named = batch.filter(pa.array(bits[(mix(ids.view(U64)) % U64(FILTER)).astype(np.int64)]))
            if named.num_rows:
                yield pa.RecordBatch.from_arrays([named.column(0), pa.array([s.tobytes() for s in text_sets(named.column(1), k)], pa.binary())], ["doc_id", "set"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    found = docs.mapInArrow(sets, "doc_id bigint, set binary")
    left = pairs.join(found.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(found.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, PAIR).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", most: int = LIST) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of ``docs``.

    Texts link when their sets of ``k``-word shingles have ``100 |A n B| >= percent |A u B|``; ``component_id`` is the smallest id
    reachable.  Fewer than ``k`` words form one shingle.  Null texts and texts without words have no shingles and
    link with nothing.  Ids may be of any kind that has an order.  Rows that repeat an id are one node.  Rows without an id link with nothing and have a null component.
    """
    if (names := ids.names_of(docs, doc_id)) is not None:
        whole = ids.numbers(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", names)
        return ids.named(near_duplicates(whole, k, percent, most=most), ["doc_id", "component_id"], names)
    with scratch(docs.sparkSession):  # its tables hold several times what it returns
        return _near_duplicates(docs, k, percent, doc_id, text, most)


def _near_duplicates(docs: DataFrame, k: int, percent: int, doc_id: str, text: str, most: int) -> DataFrame:
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = docs.where("doc_id is not null")
    cells_uri, histogram = count_shingles(docs, k)
    light = light_up_to(histogram, percent)
    mean = float(np.frombuffer(map_file(cells_uri), np.uint32).mean())
    own = stash(sets_of(docs, k, percent, cells_uri, light, int(most + 8 * mean)), "jaccard-sets")
    keyed = own.where("k1 is not null and doc_id is not null")
    classes = stash(keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("postings").alias("postings"), F.first("places").alias("places")), "jaccard-classes")
    shared = stash(shared_lists(classes, parts), "jaccard-shared")
    lists = stash(listed(distinct_lists(shared), times_met(shared)), "jaccard-lists")
    # Stars first: in a group of near copies they leave few components to pair.
    tried, links, labels = None, None, None
    for _ in range(STARS):
        star = pairs_of(lists, labels, percent, parts, False)
        star = stash(star if tried is None else star.join(tried, ["a", "b"], "left_anti"), "jaccard-star")
        found = stash(similar(star, named, k, percent), "jaccard-links", 500)
        tried = star if tried is None else tried.unionByName(star)
        links = found if links is None else links.unionByName(found)
        labels = stash(components(links), "jaccard-labels")
    rest = stash(pairs_of(lists, labels, percent, parts, True).join(tried, ["a", "b"], "left_anti"), "jaccard-apart")
    more = stash(similar(rest, named, k, percent), "jaccard-more", 500)
    # Components joined by the later links.
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
    edges = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    top = components(edges).select(F.col("node").alias("label"), F.col("component").alias("final"))
    nodes = classes.select("k1", "k2", "rep").join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rep")).drop("node", "component")
    placed = nodes.join(top, "label", "left").select("k1", "k2", F.coalesce("final", "label").alias("component"))
    out = own.select("doc_id", "n_shingles", "k1", "k2").join(placed, ["k1", "k2"], "left")
    found = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return stash(found, "near-duplicates", keep=True)


def similarity_join(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", most: int = LIST) -> tuple[DataFrame, DataFrame]:
    """The whole join, as ``(links, members)``: every link between different sets, and which documents have each set.

    ``links``: ``a, b``, ids of classes of documents with equal sets, ``a < b``, whose sets are similar as in :func:`near_duplicates`.  ``members``:
    ``doc_id, n_shingles, class_id, n_links``, one row per row of ``docs``: the class, by its smallest id, and how many other documents link with this
    one, equal ones among them.  Rows that repeat an id are one document.  A document without words has no class and no links, a row
    without an id neither.  No pair is left out: a group of n different near copies has up to n (n - 1) / 2 links.
    """
    if (names := ids.names_of(docs, doc_id)) is not None:
        whole = ids.numbers(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", names)
        links, members = similarity_join(whole, k, percent, most=most)
        return ids.named(links, ["a", "b"], names), ids.named(members, ["doc_id", "class_id"], names)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cells_uri, histogram = count_shingles(docs, k)
    mean = float(np.frombuffer(map_file(cells_uri), np.uint32).mean())
    own = stash(sets_of(docs, k, percent, cells_uri, light_up_to(histogram, percent), int(most + 8 * mean)), "join-sets")
    keyed = own.where("k1 is not null and doc_id is not null")
    first = [F.first(c).alias(c) for c in ("n_shingles", "postings", "places")]
    classes = stash(keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("size"), *first), "join-classes")
    shared = stash(shared_lists(classes, parts), "join-shared")
    lists = stash(listed(distinct_lists(shared), times_met(shared)), "join-lists")
    pairs = stash(pairs_of(lists, None, percent, parts, True), "join-pairs")
    links = stash(similar(pairs, docs.where("doc_id is not null"), k, percent), "join-links", 500)
    sizes = classes.select(F.col("rep").alias("other"), "size")
    both = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    linked = both.join(sizes, "other").groupBy("rep").agg(F.sum("size").alias("others"))
    known = classes.select("k1", "k2", "rep", "size").join(linked, "rep", "left").withColumn("n_links", F.col("size") - 1 + F.coalesce("others", F.lit(0)))
    members = own.select("doc_id", "n_shingles", "k1", "k2").join(known, ["k1", "k2"], "left")
    has = F.col("doc_id").isNotNull()
    return links, members.select("doc_id", "n_shingles", F.when(has, F.col("rep")).alias("class_id"), F.when(has, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id") -> DataFrame:
    """The documents without near duplicates: of each component the row with the smallest id stays, with all its columns.

    Of rows that repeat an id one stays.  Rows without an id stay.
    """
    found = near_duplicates(docs, k, percent, doc_id)
    known = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n"))
    known = stash(known.where("n > 1 or c <> doc_id"), "jaccard-gone")
    name = "gone_id"
    while name in docs.columns:
        name += "_"
    gone = known.where("c <> doc_id").select(F.col("doc_id").alias(name))
    left = docs.join(gone, F.col(doc_id) == F.col(name), "left_anti")
    if not known.where("n > 1").limit(1).count():
        return left
    return left.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]).unionByName(left.where(F.col(doc_id).isNull()))
