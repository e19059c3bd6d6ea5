"""Words, word hashes and shingles of many texts at once, in numpy.

Texts stay UTF-8 bytes in Arrow buffers.  Work runs in blocks of ``BLOCK`` bytes cut between words, so
memory follows the block and the number of words, not the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
U64 = np.uint64

# Multipliers of the splitmix64 finalizer, and an odd base of the polynomial hash.
MIX_A, MIX_B, GOLDEN, BASE = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, a bijection of 64-bit words."""
    x = x ^ (x >> U64(30))
    x *= U64(MIX_A)
    x ^= x >> U64(27)
    x *= U64(MIX_B)
    x ^= x >> U64(31)
    return x


def keys(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit words by rule."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(GOLDEN) + U64(seed))


#: ``bytes.translate`` table that lower-cases A-Z and nothing else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def byte_class(*spans: tuple[int, int]) -> bytes:
    """``bytes.translate`` table: 1 outside the given spans of byte values, after lower-casing, else 0."""
    return bytes(int(not any(a <= LOWER[c] <= b for a, b in spans)) for c in range(256))


def looked_up(data: np.ndarray, table: bytes, kind=np.uint8) -> np.ndarray:
    """``table[data]`` for a table of 256 bytes."""
    return np.frombuffer(data.tobytes().translate(table), kind)


#: Bytes of ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
NON_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, inverse):
        p = np.full(n, base, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _cuts(word: bytes, n: int, data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks of about BLOCK bytes that end behind a byte that is no word byte."""
    a = 0
    while a < n:
        b = min(n, a + BLOCK)
        while b < n and word[data[b - 1]]:
            step = data[b : b + 65536]
            gaps = np.flatnonzero(~looked_up(step, word, bool))
            b += int(gaps[0]) + 1 if len(gaps) else len(step)
        yield a, b
        a = b


def words(data: np.ndarray, offs: np.ndarray, word: bytes = NON_SPACE, prefix: int = 0, lower: bool = True):
    """``(hash, start, end, off)``: hash, with A-Z lower-cased, and byte span of each word; words of text i are ``off[i]:off[i+1]``.

    With ``prefix``, a fifth array: the hash of each word's first ``prefix`` bytes.  Without ``lower`` case counts.
    """
    hs, ss, es, ps = [], [], [], []
    for a, b in _cuts(word, len(data), data):
        w = looked_up(data[a:b], word, bool)
        before = np.empty(len(w), bool)
        before[0], before[1:] = False, w[:-1]
        inner = offs[np.searchsorted(offs, a, "right") : np.searchsorted(offs, b)] - a
        before[inner] = False
        start = np.flatnonzero(w & ~before)
        after = np.empty(len(w), bool)
        after[-1], after[:-1] = False, w[1:]
        after[inner - 1] = False
        end = np.flatnonzero(w & ~after) + 1
        up, down = _powers(1 << max(18, (b - a).bit_length()))
        total = np.zeros(b - a + 1, U64)
        v = (looked_up(data[a:b], LOWER) if lower else data[a:b]).astype(U64)
        v += U64(1)
        v *= up[: b - a]
        np.cumsum(v, out=total[1:])
        h = total[end] - total[start]
        h *= down[start]
        hs.append(mix(h))
        ss.append(start + a)
        es.append(end + a)
        if prefix:
            ps.append(mix((total[np.minimum(start + prefix, end)] - total[start]) * down[start]))
    if not hs:
        empty = np.zeros(0, np.int64)
        return (np.zeros(0, U64), empty, empty, np.zeros(len(offs), np.int64)) + ((np.zeros(0, U64),) if prefix else ())
    start = np.concatenate(ss)
    return (np.concatenate(hs), start, np.concatenate(es), np.searchsorted(start, offs)) + ((np.concatenate(ps),) if prefix else ())


SLOT_KEYS = keys(64, 11) | U64(1)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` words from each position on, over text borders too; ``len(h) - k + 1`` of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n] * SLOT_KEYS[0]
    for j in range(1, k):
        out += h[j : n + j] * SLOT_KEYS[j]
    return mix(out)


def shingle_sets(h: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct ``k``-word shingle hashes of each text; with fewer words the whole sequence is one shingle."""
    g = grams(h, k)
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            part = (h[a:b] * SLOT_KEYS[: b - a]).sum(dtype=U64, keepdims=True)
            out.append(mix(part + SLOT_KEYS[32 + b - a]))
        else:
            out.append(np.zeros(0, U64))
    return out


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one byte string: lengths in bytes, then the arrays, each from a multiple of 8 on."""
    parts = [np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()]
    for a in arrays:
        parts += [a.tobytes(), bytes(-a.nbytes % 8)]
    return b"".join(parts)


def unpacked(data, *kinds) -> list[np.ndarray]:
    """The arrays of :func:`packed`, in place."""
    sizes = np.frombuffer(data, np.int64, len(kinds), 8)
    at, out = 8 * (1 + len(kinds)), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at))
        at += n + -n % 8
    return out


def release() -> None:
    """Give memory that a task has freed back to the system: idle workers keep none of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into pieces of at most about ``size`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(length.astype(np.int64)) // size
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
    release()
