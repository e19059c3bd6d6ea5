"""Compact binary forms, for exchange with other producers: MessagePack positional arrays, and an envelope that names a sketch's kind.

:mod:`.portable` turns tables of sketches into such values and back.
"""

from __future__ import annotations

import dataclasses
import struct
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators.frames import Mismatch

# --- MessagePack ---


def pack(x: object) -> bytes:
    """The shortest MessagePack form of None, bool, int, float, str, bytes, list and dict."""
    if x is None:
        return b"\xc0"
    if isinstance(x, bool):
        return b"\xc3" if x else b"\xc2"
    if isinstance(x, int):
        if x >= 0:
            for limit, head, form in ((0x80, b"", ">B"), (1 << 8, b"\xcc", ">B"), (1 << 16, b"\xcd", ">H"), (1 << 32, b"\xce", ">I"), (1 << 64, b"\xcf", ">Q")):
                if x < limit:
                    return head + struct.pack(form, x)
        for limit, head, form in ((-32, b"", ">b"), (-(1 << 7), b"\xd0", ">b"), (-(1 << 15), b"\xd1", ">h"), (-(1 << 31), b"\xd2", ">i"), (-(1 << 63), b"\xd3", ">q")):
            if limit <= x < 0:
                return head + struct.pack(form, x)
        raise OverflowError(x)
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, str):
        raw = x.encode()
        return _sized(len(raw), ((32, 0xA0), (1 << 8, b"\xd9", ">B"), (1 << 16, b"\xda", ">H"), (1 << 32, b"\xdb", ">I"))) + raw
    if isinstance(x, bytes):
        return _sized(len(x), ((1 << 8, b"\xc4", ">B"), (1 << 16, b"\xc5", ">H"), (1 << 32, b"\xc6", ">I"))) + x
    if isinstance(x, (list, tuple)):
        return _sized(len(x), ((16, 0x90), (1 << 16, b"\xdc", ">H"), (1 << 32, b"\xdd", ">I"))) + b"".join(map(pack, x))
    if isinstance(x, dict):
        return _sized(len(x), ((16, 0x80), (1 << 16, b"\xde", ">H"), (1 << 32, b"\xdf", ">I"))) + b"".join(pack(k) + pack(v) for k, v in x.items())
    raise TypeError(type(x))


def _sized(n: int, forms: tuple) -> bytes:
    for limit, head, *form in forms:
        if n < limit:
            return bytes([head | n]) if not form else head + struct.pack(form[0], n)
    raise OverflowError(n)


def unpack(data: bytes) -> object:
    """One value and nothing behind it; cut-off input raises."""
    value, at = _value(data, 0)
    if at != len(data):
        raise ValueError("bytes behind the value")
    return value


_FIXED = {0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q", 0xCA: ">f", 0xCB: ">d"}
_LONG = {0xD9: (">B", "s"), 0xDA: (">H", "s"), 0xDB: (">I", "s"), 0xC4: (">B", "b"), 0xC5: (">H", "b"), 0xC6: (">I", "b"), 0xDC: (">H", "a"), 0xDD: (">I", "a"), 0xDE: (">H", "m"), 0xDF: (">I", "m")}


def _take(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise ValueError("the input ends early")
    return data[at : at + n]


def _value(data: bytes, at: int) -> tuple[object, int]:
    c = _take(data, at, 1)[0]
    at += 1
    if c < 0x80:
        return c, at
    if c >= 0xE0:
        return c - 256, at
    if c in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[c], at
    if c in _FIXED:
        n = struct.calcsize(_FIXED[c])
        return struct.unpack(_FIXED[c], _take(data, at, n))[0], at + n
    if c in _LONG:
        form, kind = _LONG[c]
        n = struct.unpack(form, _take(data, at, struct.calcsize(form)))[0]
        at += struct.calcsize(form)
    elif c < 0x90:
        n, kind = c & 15, "m"
    elif c < 0xA0:
        n, kind = c & 15, "a"
    elif c < 0xC0:
        n, kind = c & 31, "s"
    else:
        raise ValueError(f"no such byte {c:#x}")
    if kind in "sb":
        raw = _take(data, at, n)
        return (raw.decode() if kind == "s" else raw), at + n
    items = []
    for _ in range(n * (2 if kind == "m" else 1)):
        item, at = _value(data, at)
        items.append(item)
    return (dict(zip(items[::2], items[1::2], strict=True)) if kind == "m" else items), at


# --- the envelope ---

# The envelope's magic and version, and kind ids: family and form, in hexadecimal.
MAGIC, VERSION = b"ASAPv1", 1
_KINDS = """
0100 hll_unspecified, 0101 hll_classic, 0102 hll_ertl_mle, 0103 hll_hip_with_kxq, 0104 hll_hip, 0181 hll_classic_delta, 0182 hll_ertl_mle_delta
0200 count_min, 0280 count_min_delta, 0300 cms_heap, 0380 cms_heap_delta, 0400 count_sketch, 0480 count_sketch_delta
0500 ddsketch_with_scalars, 0501 ddsketch, 0580 ddsketch_with_scalars_delta, 0581 ddsketch_delta, 0600 kll, 0601 kll_dynamic
0700 hydra_kll, 0701 hydra_count_min, 0702 hydra_count_sketch, 0703 hydra_hll, 0704 hydra_univmon_with_l2, 0705 hydra_univmon
0800 set_aggregator, 0880 set_aggregator_delta, 0900 retired_09, 0a00 cs_heap, 0a80 cs_heap_delta, 0b00 elastic, 0c00 coco, 0d00 uniform_sampling, 0e00 kmv, 0f00 hash_sketch_ensemble
1000 univmon_with_l2, 1001 univmon, 1100 univmon_optimized_with_l2, 1101 univmon_optimized, 1200 nitro_batch, 1300 exponential_histogram, 1400 eh_sketch_list, 1500 eh_univ_optimized, 1600 octo_sketch
1700 bloom_with_inserted, 1701 bloom, 1800 space_saving_with_total, 1801 space_saving, 1900 count_l2hh_with_l2, 1901 count_l2hh, 1a00 univmon_q, 1b00 fold_cms, 1c00 fold_cs, 1d00 retired_1d
1e00 cms_space_saving_with_total, 1e01 cms_space_saving, 1f00 cs_space_saving_with_total, 1f01 cs_space_saving
"""
KINDS = {name: bytes.fromhex(number) for number, name in (x.split() for line in _KINDS.strip().splitlines() for x in line.split(", "))}
#: Kinds that are names without a payload.
BARE = {"hll_unspecified", "retired_09", "hash_sketch_ensemble", "nitro_batch", "eh_univ_optimized", "octo_sketch", "fold_cms", "fold_cs", "retired_1d"}


def seal(kind: str, metadata: dict, payload: bytes) -> bytes:
    """Magic, version, kind id, lengths, MessagePack metadata, payload."""
    if kind not in KINDS or kind in BARE:
        raise ValueError(f"no payload of kind {kind}")
    meta, k = pack(metadata), KINDS[kind]
    return MAGIC + bytes([VERSION, len(k)]) + k + struct.pack(">II", len(meta), len(payload)) + meta + payload


def open_sealed(data: bytes) -> tuple[str, dict, bytes]:
    """``(kind, metadata, payload)``; bytes past the payload are ignored."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not an envelope")
    at = len(MAGIC)
    version, n = _take(data, at, 2)
    if version != VERSION:
        raise ValueError(f"no version {version}")
    kind = _take(data, at + 2, n)
    at += 2 + n
    m, p = struct.unpack(">II", _take(data, at, 8))
    names = {v: k for k, v in KINDS.items()}
    if kind not in names:
        raise ValueError(f"no kind {kind!r}")
    return names[kind], unpack(_take(data, at + 8, m)), _take(data, at + 8 + m, p)


@dataclasses.dataclass(frozen=True)
class HashProfile:
    """How keys were hashed.  Names differ between producers: give those that the other side expects."""

    id: str = "cellmesh.xxh3.v1"
    algorithm: str = "xxh3_64_128"
    seed_derivation: str = "seed_list_index_wrap"
    input_encoding: str = "cellmesh.text.v1"
    seeds: tuple[int, ...] = hashing.SEEDS
    index: tuple[str, int] | None = ("canonical_seed_index", hashing.CANONICAL)

    def fields(self) -> dict:
        out = {"hash_profile_id": self.id, "hash_algorithm": self.algorithm, "seed_derivation": self.seed_derivation, "input_encoding": self.input_encoding, "seed_list": list(self.seeds)}
        return out | (dict([self.index]) if self.index else {})


def metadata(version: int, profile: HashProfile | None = None, **fields: object) -> dict:
    """A metadata map: the version, the hash profile and a sketch's own fields, in this order."""
    return {"metadata_version": version, **(profile.fields() if profile else {}), **fields}


def read_metadata(found: dict, version: int, profile: HashProfile | None = None, **kinds: type) -> dict:
    """A sketch's own fields, of these kinds.  Another version or hash profile, missing and unknown keys raise."""
    expected = metadata(version, profile)
    for key, want in expected.items():
        if key not in found:
            raise Mismatch(f"metadata has no {key}")
        if found[key] != want or type(found[key]) is not type(want):
            raise Mismatch(f"metadata {key} is {found[key]!r}, not {want!r}")
    if unknown := found.keys() - expected.keys() - kinds.keys():
        raise Mismatch(f"metadata has an unknown key {sorted(unknown)[0]}")
    for key, kind in kinds.items():
        if type(found.get(key)) is not kind:
            raise Mismatch(f"metadata {key} is no {kind.__name__}")
    return {key: found[key] for key in kinds}


def sealed(frames: DataFrame, kind: str, meta: dict) -> DataFrame:
    """``(..., data)`` with each payload in an envelope."""

    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: seal(kind, meta, bytes(x)))

    return frames.withColumn("data", run("data"))


def opened(frames: DataFrame, kind: str, version: int, profile: HashProfile | None = None, **kinds: type) -> DataFrame:
    """The payloads of envelopes of one kind; metadata is read strictly."""

    def one(data: bytes) -> bytes:
        found, meta, payload = open_sealed(bytes(data))
        if found != kind:
            raise Mismatch(f"a {found}, not a {kind}")
        read_metadata(meta, version, profile, **kinds)
        return payload

    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        return data.map(one)

    return frames.withColumn("data", run("data"))


# --- sketch frames: positional arrays ---


def cm_frame(matrix: list[list[float]], signed: bool) -> bytes:
    """``[matrix, rows, cols]``; with signs ``[rows, cols, matrix]``."""
    rows, cols = len(matrix), len(matrix[0])
    if any(len(r) != cols for r in matrix):
        raise Mismatch("rows of different lengths")
    return pack([rows, cols, matrix] if signed else [matrix, rows, cols])


def cm_matrix(data: bytes, signed: bool) -> list[list[float]]:
    frame = _array(unpack(data), 3)
    rows, cols, matrix = frame if signed else (frame[1], frame[2], frame[0])
    if len(matrix) != rows or any(len(r) != cols for r in matrix):
        raise Mismatch("the matrix has other dimensions than its frame says")
    return matrix


def _array(x: object, n: int) -> list:
    if not isinstance(x, list) or len(x) != n:
        raise ValueError(f"not an array of {n}")
    return x


def heap_frame(matrix: list[list[float]], heap: Iterable[tuple[str, float]], size: int) -> bytes:
    """``[[matrix, rows, cols], [[key, value], ...], heap size]``: a sketch with its heaviest keys."""
    return pack([unpack(cm_frame(matrix, False)), [[k, float(v)] for k, v in heap], size])


def heap_values(data: bytes) -> tuple[list[list[float]], list[tuple[str, float]], int]:
    inner, heap, size = _array(unpack(data), 3)
    return cm_matrix(pack(inner), False), [tuple(_array(x, 2)) for x in heap], size


def heap_delta_frame(rows: int, cols: int, cells: Iterable[tuple[int, int, int]], heap: Iterable[tuple[str, float]], size: int) -> bytes:
    """``[true, [rows, cols, [[row, column, change], ...]], [[key, value], ...], heap size]``: changed cells and the whole heap."""
    return pack([True, [rows, cols, [list(c) for c in cells]], [[k, float(v)] for k, v in heap], size])


def heap_delta_values(data: bytes) -> tuple[int, int, list[tuple[int, int, int]], list[tuple[str, float]], int]:
    marker, inner, heap, size = _array(unpack(data), 4)
    if marker is not True:
        raise ValueError("not a delta")
    rows, cols, cells = _array(inner, 3)
    cells = [tuple(_array(c, 3)) for c in cells]
    if any(not (0 <= r < rows and 0 <= c < cols) for r, c, _ in cells):
        raise Mismatch("a cell outside the matrix")
    return rows, cols, cells, [tuple(_array(x, 2)) for x in heap], size


def is_delta(data: bytes) -> bool:
    """A four-array that begins with true is a heap delta frame."""
    return data[:2] == b"\x94\xc3"


def columns_frame(*columns: Iterable) -> bytes:
    """Parallel arrays, such as ``[registers, values]`` or ``[buckets, changes]``."""
    return pack([list(c) for c in columns])


def columns_values(data: bytes, n: int) -> list[tuple]:
    columns = _array(unpack(data), n)
    if len({len(c) for c in columns}) > 1:
        raise Mismatch("columns of different lengths")
    return list(zip(*columns, strict=True))


def cell_delta_frame(rows: int, cols: int, cells: Iterable[tuple[int, int, float]]) -> bytes:
    """``[rows, cols, row numbers, column numbers, changes]``; changes are whole numbers or doubles."""
    r, c, d = (list(x) for x in zip(*cells, strict=True)) if (cells := list(cells)) else ([], [], [])
    return pack([rows, cols, r, c, d])


def cell_delta_values(data: bytes) -> tuple[int, int, list[tuple]]:
    rows, cols, *columns = _array(unpack(data), 5)
    if len({len(c) for c in columns}) > 1:
        raise Mismatch("columns of different lengths")
    return rows, cols, list(zip(*columns, strict=True))


def hll_frame(variant: str, registers: list[int]) -> bytes:
    """``[variant, precision, registers, 0, 0, 0]``, registers as small integers in an array."""
    return pack([variant, len(registers).bit_length() - 1, registers, 0.0, 0.0, 0.0])


def hll_registers(data: bytes) -> tuple[str, list[int]]:
    variant, precision, registers, *_ = _array(unpack(data), 6)
    if len(registers) != 1 << precision:
        raise Mismatch("the precision does not fit the registers")
    return variant, registers


def dd_frame(alpha: float, buckets: dict[int, int]) -> bytes:
    """``[alpha, counts from the lowest bucket on, lowest bucket]``."""
    low, high = (min(buckets), max(buckets)) if buckets else (0, -1)
    return pack([alpha, [buckets.get(b, 0) for b in range(low, high + 1)], low])


def dd_buckets(data: bytes) -> tuple[float, dict[int, int]]:
    alpha, counts, low = _array(unpack(data), 3)
    return alpha, {low + i: n for i, n in enumerate(counts) if n}


# --- protobuf wire format ---


def varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def zigzag(n: int) -> int:
    return (n << 1) ^ (n >> 63)


def unzigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)
