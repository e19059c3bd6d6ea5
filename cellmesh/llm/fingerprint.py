"""Improbable-feature digests of whole documents.

Every 16-byte window of a text is a feature; a shorter text is filled with zeros to one window.  The corpus tells how often each entropy of windows occurs; the rarer an entropy, the better a feature's rank.  A feature is selected where it has the best rank in many
of the runs of windows around it.  Selected features set bits in Bloom filters; a full filter is followed by
the next, so a digest grows with its text.  Two digests are compared filter by filter: the share of common bits, less
what chance gives, from 0 to 1.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ids
from .shared import map_file, new_folder, write_file
from .text import BASE, U64, buffers, chunks, mix

WINDOW = 16
#: Entropy steps; windows of a run in which a feature competes, and how many runs it must win, in texts of 1 KB and more.
STEPS, RUN, WINS = 1000, 32, 8
#: Bits of a filter, bits that a feature sets, features that a filter takes.
BITS, HASHES, FEATURES = 2048, 5, 160
#: Bytes of text worked on at once; positions within it take 19 bits.
CHUNK = 1 << 18


#: ``c log2 c`` in fixed point, so that an entropy depends on its window alone, not on what was added up before.
_C = np.arange(WINDOW + 2, dtype=float)
_PLOGP = np.rint(_C * np.log2(np.maximum(_C, 1)) * (1 << 20)).astype(np.int64)
_LEAVE = np.concatenate([[0], _PLOGP[:-1] - _PLOGP[1:]])  # a count goes from c to c - 1
_ENTER = _PLOGP[1:] - _PLOGP[:-1]  # a count goes from c to c + 1


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy of each window, in ``0 .. STEPS``: ``STEPS`` where all bytes differ.

    Moving a window on by one byte changes two counts: of the byte that leaves and of the one that enters.  Comparing the data
    with itself at all distances within a window counts both for all places at once.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    after, before = np.ones(len(data), np.uint8), np.zeros(len(data), np.uint8)
    same = np.empty(len(data), bool)
    for j in range(1, WINDOW):
        m = len(data) - j
        np.equal(data[:m], data[j:], out=same[:m])
        after[:m] += same[:m].view(np.uint8)
        before[j:] += same[:m].view(np.uint8)
    total = np.empty(n, np.int64)
    total[0] = _PLOGP[np.bincount(data[:WINDOW])].sum()
    # `before` of the entering byte counts the places of the old window but its first, which has left.
    np.add(_LEAVE[after[: n - 1]], _ENTER[before[WINDOW:]], out=total[1:])
    np.cumsum(total, out=total)
    return np.clip(np.rint((np.log2(WINDOW) - total * (1.0 / (WINDOW << 20))) * (STEPS / np.log2(WINDOW))), 0, STEPS).astype(np.int64)


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(data, offs, runs)``: texts with zeros behind each, where each begins, and at each byte that starts a window how many make a run, else 0.

    Texts of under 512 bytes have shorter runs, down to 4.  What wins a long run also wins the short ones in it: shorter runs only add features.
    """
    size = np.array([max(len(t), WINDOW) if t else 0 for t in texts], np.int64)
    gap = max(WINDOW, RUN) - 1
    offs = np.concatenate([[0], np.cumsum(size + gap)])
    data = np.frombuffer(b"".join(t.ljust(n + gap, b"\0") for t, n in zip(texts, size.tolist(), strict=True)), np.uint8)
    edges, full = np.zeros(len(data) + 1, np.int8), size > 0
    run = np.clip(np.left_shift(1, np.log2(np.maximum(size // 16, 1)).astype(np.int64)), 4, RUN)
    edges[offs[:-1][full]] = run[full]
    edges[(offs[:-1] + size - WINDOW + 1)[full]] -= run[full].astype(np.int8)
    return data, offs, np.cumsum(edges[:-1], dtype=np.int8)


def wins(data: np.ndarray, runs: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """How many runs of its text each window wins: least rank, leftmost of equals.  A run at the end has fewer windows."""
    out = np.zeros(len(data), np.uint8)
    for a in range(0, len(data), CHUNK):
        piece = data[a : a + CHUNK + RUN + WINDOW - 2]
        e = entropies(piece)
        own = runs[a : a + len(e)]
        best = np.where(own > 0, ranks[e], STEPS + 1).astype(np.int32)
        best <<= 19
        best |= np.arange(len(best), dtype=np.int32)
        step = 1
        while step < RUN:  # doubling finds the least of a run
            best = np.minimum(best[:-step], best[step:])
            step *= 2
            here = np.flatnonzero(own[: min(len(best), CHUNK)] == step)
            count = np.bincount(best[here] & ((1 << 19) - 1))
            out[a : a + len(count)] += count.astype(np.uint8)
    return out


_POWERS = np.multiply.accumulate(np.full(WINDOW, BASE, U64))


def features(texts: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, text)`` of the distinct selected features of texts, in order.

    A window must win as many runs as the text has 128s of bytes, 1 at least and ``WINS`` at most: what a longer text selects, a
    shorter one with the same window would too.  Of a text in which none wins often enough the best is taken.
    """
    data, offs, runs = padded(texts)
    size = np.array([len(t) for t in texts], np.int64)
    won = wins(data, runs, ranks)
    at = np.flatnonzero(won)
    of = np.searchsorted(offs, at, "right") - 1
    enough = won[at] >= np.clip(size[of] // 128, 1, WINS)
    at, of = at[enough], of[enough]
    none = np.flatnonzero((np.bincount(of, minlength=len(texts)) == 0) & (size > 0))
    if len(none):
        best = [offs[i] + int(np.argmin(ranks[entropies(data[offs[i] : offs[i] + size[i]])])) for i in none]
        at, of = np.concatenate([at, best]), np.concatenate([of, none])
    h = np.zeros(0, U64)
    if len(at):
        view = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
        parts = [((view[at[i : i + 8192]].astype(U64) + U64(1)) * _POWERS).sum(axis=1, dtype=U64) for i in range(0, len(at), 8192)]
        h = mix(np.concatenate(parts))
    order = np.lexsort((at, of))
    h, of = h[order], of[order]
    _, first = np.unique(mix(of.astype(U64) + U64(1)) ^ h, return_index=True)
    first.sort()
    return h[first], of[first]


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Each text's chain of filters, one a row of ``BITS / 64`` words: a function of its bytes and the ranks."""
    h, of = features(texts, ranks)
    n = np.bincount(of, minlength=len(texts))
    starts = np.cumsum(n) - n
    filters = -(-n // FEATURES)
    base = np.cumsum(filters) - filters
    row = base[of] + (np.arange(len(h)) - starts[of]) // FEATURES
    bits = np.zeros((int(filters.sum()), BITS), bool)
    for j in range(HASHES):
        bits[row, ((h >> U64(11 * j)) & U64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1).view(U64)
    return [packed[b : b + k] for b, k in zip(base.tolist(), filters.tolist(), strict=True)]


def encode(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), U64).reshape(-1, BITS // 64)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """From 0 to 1: the mean over the shorter chain, weighted by bits, of each filter's best overlap with the other's.

    Overlap is what two filters share beyond the bits that chance sets in both, as a part of the most they could share
    beyond chance.  Equal chains are alike by 1, two empty ones too; an empty and another by 0.
    """
    if x.shape == y.shape and (x == y).all():
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    a, b = (x, y) if len(x) <= len(y) else (y, x)
    na, nb = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    total = 0.0
    for f, n in zip(a, na.tolist(), strict=True):
        both = np.bitwise_count(b & f).sum(axis=1, dtype=np.int64)
        chance = n * nb / BITS
        share = (both - chance) / np.maximum(np.minimum(n, nb) - chance, 1e-9)
        total += n * min(1.0, max(0.0, float(share.max())))
    return total / float(na.sum())


def rarity(docs: DataFrame, text: str = "text") -> str:
    """URI of the rank of each entropy: 0 for the rarest among the windows of all documents.

    Windows without any variety and entropies that never occur take the last ranks.  A fixed-size table of counts comes to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(STEPS + 1, np.int64)
        for batch in chunks(batches, "text", CHUNK):
            data, offs = buffers(batch.column(0))
            for a in range(0, len(data), CHUNK):
                e = entropies(data[a : a + CHUNK + WINDOW - 1])
                inside = np.ones(len(e), bool)
                for edge in offs[(offs > a) & (offs < a + len(e) + WINDOW)].tolist():
                    inside[max(0, edge - a - WINDOW + 1) : edge - a] = False
                seen += np.bincount(e[inside], minlength=STEPS + 1)
        at = np.flatnonzero(seen)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["step", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "step int, n bigint").groupBy("step").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(STEPS + 1, np.int64)
    for r in rows:
        seen[r["step"]] = r["n"]
    weak = (seen == 0) | (np.arange(STEPS + 1) < STEPS // 10)
    order = np.lexsort((np.arange(STEPS + 1), seen, weak))
    ranks = np.empty(STEPS + 1, np.int32)
    ranks[order] = np.arange(STEPS + 1)
    uri = f"{new_folder(docs.sparkSession, 'rarity')}/ranks"
    write_file(uri, ranks.tobytes())
    return uri


def edited(text: str, following: str) -> str:
    """``text`` whose last half of code points, rounded down, is as many first ones of the next, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def bucket_bounds(docs: DataFrame, doc_id: str, parts: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Ascending ids that cut the table into about ``parts`` ranges, and ``(range, largest id)`` of the ranges with rows."""
    cuts = docs.where(F.col(doc_id).isNotNull()).approxQuantile(doc_id, [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = sorted({int(c) for c in cuts})
    heads = docs.where(F.col(doc_id).isNotNull()).groupBy(bucket_of(F.col(doc_id), bounds).alias("b")).agg(F.max(doc_id).alias("head")).collect()
    return bounds, sorted((r["b"], r["head"]) for r in heads)


def bucket_of(doc_id: Column, bounds: list[int]) -> Column:
    """The range of an id, by halving: the number of bounds below it."""
    if not bounds:
        return F.lit(0)

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(doc_id > bounds[mid], search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(bounds))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, one row per row.

    The next document is the one with the next smaller id, after the smallest the largest; ties go by text, rows
    without an id come last.  Ids may be of any kind that has an order.  Null texts are empty; an empty text has the empty fingerprint.  One document alone is its own next.

    Documents are dealt by ranges of ids and sorted.  The first document of each range is also sent to the range before it,
    as only its text is missing there.
    """
    if (names := ids.names_of(docs, doc_id)) is not None:
        whole = ids.numbers(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", names)
        return ids.named(fingerprints(whole, parts=parts), ["doc_id"], names)
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranks_uri = rarity(docs)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, heads = bucket_bounds(docs, "doc_id", parts)
    # Ranges by falling id; rows without an id come after all others.
    order = [b for b, _ in reversed(heads)]
    first = {b: head for b, head in heads}
    nulls = len(bounds) + 1
    if docs.where("doc_id is null").limit(1).count():
        order.append(nulls)
    rank = {b: i for i, b in enumerate(order)}
    own = F.when(F.col("doc_id").isNull(), F.lit(rank.get(nulls, 0)))
    place = bucket_of(F.col("doc_id"), bounds)
    own = own.otherwise(F.element_at(F.array(*[F.lit(rank.get(b, 0)) for b in range(len(bounds) + 1)]), place + 1))
    # The head of each range also goes to the range before it, that of the first to the last.  Without an id, any such row may come first.
    lends = [(first.get(b), (i - 1) % len(order)) for i, b in enumerate(order)]
    named = [F.lit(x) for head, to in lends if head is not None for x in (head, to)]
    lent = F.element_at(F.create_map(*named), F.col("doc_id")) if named else F.lit(None).cast("int")
    if nulls in rank:
        lent = F.when(F.col("doc_id").isNull(), F.lit((rank[nulls] - 1) % len(order))).otherwise(lent)
    copies = F.array(F.struct(own.alias("part"), F.lit(False).alias("lent")), F.struct(lent.alias("part"), F.lit(True).alias("lent")))
    dealt = docs.withColumn("to", F.explode(F.filter(copies, lambda c: c["part"].isNotNull()))).select("doc_id", "text", "to.part", "to.lent")
    ranges = max(1, len(order))
    by_part = dealt.repartition(ranges, "part").sortWithinPartitions("part", "lent", F.col("doc_id").desc_nulls_last(), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.frombuffer(map_file(ranks_uri), np.int32)
        run: list[tuple[int, str]] = []  # documents in order; the last waits for its next one
        filters: list[np.ndarray] = []  # of the first, if it waited
        size, here, closed = 0, None, False

        def finish() -> pa.RecordBatch:
            nonlocal run, filters, size
            texts = [t for _, t in run]
            changed = [edited(t, u).encode() for t, u in zip(texts[:-1], texts[1:], strict=True)]
            known = len(filters)
            fresh = digests([t.encode() for t in texts[known:]] + changed, ranks)
            mine, other = filters + fresh[: len(texts) - known], fresh[len(texts) - known :]
            rows = [
                (i, len(t), hashlib.sha256(c).hexdigest(), encode(m), encode(o), likeness(m, o), likeness(m, nxt))
                for (i, t), c, m, o, nxt in zip(run[:-1], changed, mine[:-1], other, mine[1:], strict=True)
            ]
            run, filters, size = run[-1:], mine[-1:], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)

        for batch in chunks(batches):
            for i, t, part, lent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != here:
                    if len(run) > 1:
                        yield finish()
                    run, filters, here, closed = [], [], part, False
                if closed:  # a second row that repeats a lent id
                    continue
                run.append((i, t))
                closed = lent
                size += len(t)
                if size > CHUNK and len(run) > 1:
                    yield finish()
        if len(run) > 1:
            yield finish()

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return by_part.mapInArrow(work, schema)


KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
