"""Interpolated modified Kneser-Ney model of word pairs, counted in Spark and memory-mapped by workers.

``p(w | h) = (c(h w) - D(c(h w))) / c(h) + (D1 n1(h) + D2 n2(h) + D3 n3(h)) / c(h) * q(w)``, where ``n_k(h)`` counts the words that
follow h k times (three: at least), and ``q`` is the same over continuation counts, the number of different words before w,
down to the uniform distribution over the V words known and one unknown.  After an unknown h, p is q.  Discounts come from
the counts of counts over the whole corpus.

Words are 64-bit hashes, kept whole.  The range of hashes is cut into shards: one shard has the pairs whose first word, and the words whose
own hash, is in its range.  A map task counts distinct pairs in sorted arrays before anything is shuffled.  A reducing task gets several shards,
sorted, and holds one at a time.  Each shard becomes a file of sorted arrays in the shared folder; scoring looks the sorted distinct
pairs of many documents up in memory maps, so a worker holds pages that it touches, not the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_file, new_folder, stash, write_file
from .text import NON_SPACE, U64, buffers, chunks, packed, release, unpacked, words

BEGIN, END = U64(0x5A17C3E9B4D2F681), U64(0xC0FFEE1234ABCD77)
#: Words that a task counts, or looks up, at a time.
HELD = 1_000_000
#: Shards for each shuffle partition: a task holds one at a time, and gets about as many bytes as the others.
SPLIT = 8


def pairs_of(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word, text, first)`` of each token, each text's words and then its end; ``first`` marks the token after the beginning."""
    d = len(off) - 1
    n = np.diff(off)
    text = np.repeat(np.arange(d), n + 1)
    word = np.empty(len(h) + d, U64)
    at = np.arange(len(h)) + np.repeat(np.arange(d), n)
    word[at] = h
    word[off[1:] + np.arange(d)] = END
    first = np.zeros(len(word), bool)
    first[off[:-1] + np.arange(d)] = True
    return word, text, first


def numbered(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(u, own, before)``: sorted distinct words with the beginning among them, each token's number and that of the one before it."""
    u, inverse = np.unique(np.concatenate([word, [BEGIN]]), return_inverse=True)
    own = inverse[:-1]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[first] = inverse[-1]
    return u, own, before


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a hash: its part of the range, in the order of hashes."""
    return ((h >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def groups(shards: int) -> int:
    """Groups of ``SPLIT`` shards, a shuffle partition each."""
    return -(-shards // SPLIT)


def small(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts as bytes, and places and values of those over 254."""
    big = np.flatnonzero(counts > 254)
    out = np.minimum(counts, 255).astype(np.uint8)
    return out, big.astype(np.int64), counts[big].astype(np.int64)


def large(low: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = low.astype(np.int64)
    out[at] = value
    return out


# Word counts of a shard: hash, count.  Followers: first words, how many followers each, followers, counts.
WORDS = (U64, np.int64)
FOLLOWERS = (U64, np.uint32, U64, np.uint8, np.int64, np.int64)


def count(docs: DataFrame, shards: int) -> DataFrame:
    """``shard, words, followers``: packed counts of each map task, by shard."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            word = np.concatenate([x for x, _ in held])
            first = np.concatenate([x for _, x in held])
            u, own, before = numbered(word, first)
            n = np.bincount(own, minlength=len(u))
            code, times = np.unique(before * np.int64(len(u)) + own, return_counts=True)
            left, right = code // len(u), u[code % len(u)]
            cut = np.searchsorted(shard_of(u, shards), np.arange(shards + 1))
            edge = np.searchsorted(left, cut)
            uni, bi, full = [], [], np.flatnonzero(np.diff(cut)).tolist()
            for s in full:
                a, b = cut[s], cut[s + 1]
                seen = n[a:b] > 0
                uni.append(packed(u[a:b][seen], n[a:b][seen].astype(np.int64)))
                p, q = edge[s], edge[s + 1]
                who, many = np.unique(left[p:q], return_counts=True)
                bi.append(packed(u[who], many.astype(np.uint32), right[p:q], *small(times[p:q])))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(uni, pa.binary()), pa.array(bi, pa.binary())], ["shard", "words", "followers"])

        for batch in chunks(batches):
            h, _, _, off = words(*buffers(batch.column(0)), NON_SPACE)
            word, _, first = pairs_of(h, off)
            held.append((word, first))
            size += len(word)
            if size > 4 * HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(rows, "shard int, words binary, followers binary")


def summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their values."""
    if not len(key):
        return key, value
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    return key[starts], np.add.reduceat(value, starts)


# A shard's pair file: first words' hashes, where their followers begin, totals, followers seen once, twice, more; followers; counts.
PAIRS = (U64, np.int64, np.float32, np.uint32, np.uint32, np.uint32, U64, np.uint8, np.int64, np.int64)


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """``(shard, columns)`` of rows that come sorted by their first column: one shard's byte strings at a time."""
    here, held = None, []
    for batch in batches:
        for shard, *data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != here:
                if held:
                    yield here, [list(c) for c in zip(*held, strict=True)]
                here, held = shard, []
            held.append(data)
    if held:
        yield here, [list(c) for c in zip(*held, strict=True)]


def merged_pairs(fields: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(firsts, begin, after, times)`` of followers as tasks sent them: each pair once, sorted by first word and follower."""
    firsts, number = np.unique(np.concatenate([np.repeat(f[0], f[1]) for f in fields]), return_inverse=True)
    after, times = np.concatenate([f[2] for f in fields]), np.concatenate([large(*f[3:]) for f in fields])
    fields.clear()
    order = np.lexsort((after, number))
    number, after, times = number[order], after[order], times[order]
    starts = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (after[1:] != after[:-1])])) if len(number) else np.zeros(0, np.int64)
    times = np.add.reduceat(times, starts) if len(starts) else times
    return firsts, np.searchsorted(number[starts], np.arange(len(firsts) + 1)), after[starts], times


def gather(parts: DataFrame, shards: int, folder: str) -> DataFrame:
    """Write each shard's word and pair files; ``shard, stats, to, data``: counts of a shard, and continuation counts of followers in group ``to`` of shards."""

    def merge(shard: int, uni: list[bytes], bi: list[bytes]) -> tuple[dict, np.ndarray, np.ndarray]:
        h, n = summed(*(np.concatenate(x) for x in zip(*(unpacked(d, *WORDS) for d in uni), strict=True)))
        write_file(f"{folder}/words-{shard}", packed(h, n))
        firsts, begin, after, times = merged_pairs([unpacked(d, *FOLLOWERS) for d in bi])
        number = np.repeat(np.arange(len(firsts)), np.diff(begin))
        by = lambda mask: np.bincount(number[mask], minlength=len(firsts)).astype(np.uint32)
        total = np.bincount(number, times, len(firsts)).astype(np.float32)
        write_file(f"{folder}/pairs-{shard}", packed(firsts, begin.astype(np.int64), total, by(times == 1), by(times == 2), by(times > 2), after, *small(times)))
        once = [int((times == k).sum()) for k in (1, 2, 3, 4)]
        return {"shard": shard, "stats": [int(n.sum()), len(h), len(after), *once], "to": None, "data": None}, *np.unique(after, return_counts=True)

    def given(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        to, continued = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        group = shard_of(to, shards) // SPLIT
        cut = np.searchsorted(group, np.arange(groups(shards) + 1))
        rows = [{"shard": None, "stats": None, "to": g, "data": packed(to[cut[g] : cut[g + 1]], *small(continued[cut[g] : cut[g + 1]]))} for g in np.flatnonzero(np.diff(cut)).tolist()]
        return pa.RecordBatch.from_pylist(rows, schema=kinds)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of several shards, as words follow many others
        for shard, (uni, bi) in by_shard(batches):
            stats, to, continued = merge(shard, uni, bi)
            yield pa.RecordBatch.from_pylist([stats], schema=kinds)
            held.append((to, continued))
            if sum(len(x) for x, _ in held) > 4 * HELD:
                yield given(held)
                held = []
        if held:
            yield given(held)
        release()

    kinds = pa.schema([("shard", pa.int32()), ("stats", pa.list_(pa.int64())), ("to", pa.int32()), ("data", pa.binary())])
    dealt = parts.repartition(groups(shards), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(rows, "shard int, stats array<bigint>, to int, data binary")


def continue_words(parts: DataFrame, shards: int, folder: str) -> DataFrame:
    """Write each shard's continuation counts beside its words; ``stats``: their total and counts of counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for group, (data,) in by_shard(batches):
            fields = [unpacked(d, U64, np.uint8, np.int64, np.int64) for d in data]
            w, n = summed(np.concatenate([f[0] for f in fields]), np.concatenate([large(*f[1:]) for f in fields]))
            cut = np.searchsorted(shard_of(w, shards), np.arange(group * SPLIT, min(shards, (group + 1) * SPLIT) + 1))
            for shard, a, b in zip(range(group * SPLIT, shards), cut[:-1], cut[1:], strict=False):
                if b > a:
                    h, _ = unpacked(map_file(f"{folder}/words-{shard}"), *WORDS)
                    counts = np.zeros(len(h), np.int64)
                    counts[np.searchsorted(h, w[a:b])] = n[a:b]
                    write_file(f"{folder}/continued-{shard}", packed(*small(counts)))
                    out.append([int(counts.sum()), *(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts > 2).sum())])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["stats"])

    return parts.repartition(groups(shards), "to").sortWithinPartitions("to").mapInArrow(rows, "stats array<bigint>")


def discounts(n: list[int]) -> list[float]:
    """``[0, D1, D2, D3]`` of modified Kneser-Ney from the numbers of things seen 1, 2, 3 and 4 times.

    Where one of these is 0, too little was seen to estimate: 0.5, 1 and 1.5 stand in.
    """
    if not all(n):
        return [0.0, 0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [0.0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))]


@dataclass(frozen=True)
class Model:
    """Where the shards are, and what holds for all of them."""

    folder: str
    shards: int
    have: frozenset[int]
    tokens: int
    known: int
    pairs: int
    pair_discounts: list[float] = field(default_factory=list)
    word_discounts: list[float] = field(default_factory=list)
    word_backoff: float = 1.0


def train(docs: DataFrame, shards: int | None = None, text: str = "text") -> Model:
    """Count all of ``docs`` and write the model.  Null texts are empty: an end after the beginning.  Repeated rows count as often as
    they are there; other columns are not read.  ``shards``: ``SPLIT`` for each shuffle partition, by default.
    """
    spark = docs.sparkSession
    shards = shards or SPLIT * int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, "lm")
    gathered = stash(gather(count(docs.select(F.col(text).alias("text")), shards), shards, folder), "lm-gathered")
    total = gathered.where("stats is not null").select(F.collect_list("shard").alias("have"), *(F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(7))).first()
    if not total["have"]:
        return Model(folder, shards, frozenset(), 0, 0, 0, discounts([0] * 4), discounts([0] * 4), 1.0)
    again = stash(continue_words(gathered.where("data is not null").select("to", "data"), shards, folder), "lm-continued")
    c = again.select(*(F.sum(F.get("stats", F.lit(i))).alias(f"c{i}") for i in range(6))).first()
    d = discounts([c[f"c{k}"] for k in (1, 2, 3, 4)])
    backoff = (d[1] * c["c1"] + d[2] * c["c2"] + d[3] * c["c5"]) / c["c0"]
    return Model(folder, shards, frozenset(total["have"]), total["s0"], total["s1"], total["s2"], discounts([total[f"s{k}"] for k in (3, 4, 5, 6)]), d, backoff)


@lru_cache(maxsize=1 << 14)
def _words(folder: str, shard: int):
    return unpacked(map_file(f"{folder}/words-{shard}"), *WORDS), unpacked(map_file(f"{folder}/continued-{shard}"), np.uint8, np.int64, np.int64)


@lru_cache(maxsize=1 << 14)
def _pairs(folder: str, shard: int):
    return unpacked(map_file(f"{folder}/pairs-{shard}"), *PAIRS)


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place, found)`` of wanted keys in sorted ones."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def find_within(keys: np.ndarray, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place, found)`` of each wanted key in its own sorted stretch of ``keys``, all stretches halved together."""
    lo, hi = begin.copy(), end.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        less = keys[mid] < wanted[open_]
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)
        open_ = open_[lo[open_] < hi[open_]]
    at = np.minimum(lo, max(0, len(keys) - 1))
    return at, (lo < end) & (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def _counts(low: np.ndarray, big: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = low[at].astype(np.int64)
    over = np.flatnonzero(out == 255)
    if len(over):
        out[over] = value[np.searchsorted(big, at[over])]
    return out


def word_table(model: Model, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and continuation probabilities of sorted words."""
    n, continued = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
    cut = np.searchsorted(shard_of(u, model.shards), np.arange(model.shards + 1))
    for s in model.have:
        a, b = cut[s], cut[s + 1]
        if b > a:
            (h, c), more = _words(model.folder, s)
            at, found = find(h, u[a:b])
            n[a:b] = np.where(found, c[at], 0) if len(c) else 0
            continued[a:b] = np.where(found, _counts(*more, at), 0) if len(c) else 0
    d = np.array(model.word_discounts)
    p = np.maximum(continued - d[np.minimum(continued, 3)], 0) / max(1, model.pairs) + model.word_backoff / (model.known + 1)
    return n, p


def pair_probabilities(model: Model, first: np.ndarray, word: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``p(word | first)`` of pairs sorted by ``first``, from continuation probabilities ``q`` of the words."""
    out = q.copy()
    d = np.array(model.pair_discounts)
    cut = np.searchsorted(shard_of(first, model.shards), np.arange(model.shards + 1))
    for s in model.have:
        a, b = cut[s], cut[s + 1]
        if b == a:
            continue
        firsts, begin, total, n1, n2, n3, after, *counts = _pairs(model.folder, s)
        at, found = find(firsts, first[a:b])
        at, some = at[found], np.flatnonzero(found) + a
        place, seen = find_within(after, begin[at], begin[at + 1], word[some])
        c = np.where(seen, _counts(*counts, place), 0) if len(after) else np.zeros(len(some), np.int64)
        lower = d[1] * n1[at] + d[2] * n2[at] + d[3] * n3[at]
        out[some] = (np.maximum(c - d[np.minimum(c, 3)], 0) + lower * q[some]) / total[at].astype(float)
    return out


def score_tokens(model: Model, h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(score, base, known)`` of texts: log10 probabilities by the model and by smoothed word counts, and words seen in training."""
    word, text, first = pairs_of(h, off)
    u, own, before = numbered(word, first)
    n, q = word_table(model, u)
    code, inverse = np.unique(before * np.int64(len(u)) + own, return_inverse=True)
    left, right = code // len(u), code % len(u)
    p = pair_probabilities(model, u[left], u[right], q[right])
    m = len(off) - 1
    base = np.log10((n + 1) / (model.tokens + (model.known + 1)))
    return np.bincount(text, np.log10(p)[inverse], m), np.bincount(text, base[own], m), np.bincount(text, n[own] > 0, m).astype(np.int64)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity``, one row per row of ``docs``.

    A text's tokens are its words, A-Z lower-cased, and one end; a null text has the end alone.  Repeated rows score alike.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate([x[1] for x in held])
            n = np.concatenate([np.diff(x[2]) for x in held])
            s, base, known = score_tokens(model, h, np.concatenate([[0], np.cumsum(n)]))
            ids = pa.concat_arrays([x[0] for x in held])
            train = np.full(len(n), model.tokens)
            return pa.RecordBatch.from_arrays([ids, pa.array(n + 1), pa.array(known), pa.array(train), pa.array(base), pa.array(s), pa.array(10 ** (-s / (n + 1)))], NAMES)

        for batch in chunks(batches):
            h, _, _, off = words(*buffers(batch.column(1)), NON_SPACE)
            held.append((batch.column(0), h, off))
            size += len(h) + len(off)
            if size > HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    schema = f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, schema)


NAMES = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]


def held_out(doc_id: Column) -> Column:
    """Documents that a model with a held-out fold does not learn from: remainder 2 of 7."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))
