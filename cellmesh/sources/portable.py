"""Sketches as single binary values and back, for exchange with other producers: protobuf messages of states and of deltas.

A sketch's tables become long rows ``(*by, t, a, b, c, v, s)``; the rows of a group, which parameters bound, become one message.  Reading checks every
message against the parameters that the caller expects: another shape, a cut-off or an impossible message raises.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterable
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators.ddsketch import DDSketch
from ..operators.frames import Mismatch, as_list, dealt
from ..operators.heavy import LIGHT, Coco, Elastic, each_group
from ..operators.hll import HLL, M, P
from ..operators.hydra import GRID, Hydra
from ..operators.kll import KLL
from ..operators.linear import Linear, Shape
from ..operators.tracked import Delta, Tracked
from ..operators.univmon import Pyramid, UnivMon
from . import codecs
from .codecs import unzigzag, varint, zigzag

# The fields of the exchange format's messages, ``number name kind``; ``*`` marks repeated fields, numbers packed.
_FIELDS = """
Envelope: 1 format_version uint, 2 producer Producer, 3 hash_spec HashSpec, 4 sample_p double, 10 count_min CountMin, 11 count_sketch CountSketch, 12 hll HyperLogLog, 13 kll KLL, 14 ddsketch DDSketch, 15 univmon UnivMon, 16 hydra Hydra, 17 coco Coco, 18 elastic Elastic
DeltaEnvelope: 1 partition_key string, 2 window_start_ms int, 3 is_window_close bool, 10 count_min CountMinDelta, 11 count_sketch CountSketchDelta, 12 hll HLLDelta, 13 ddsketch DDSketchDelta
Producer: 1 library string, 2 version string
HashSpec: 1 algorithm uint, 2 canonical_seed_index uint, 3 seed_list *uint, 4 seed_derivation uint
CountMin: 1 rows uint, 2 cols uint, 3 counter_type uint, 4 counts_int *sint, 5 counts_float *double, 6 sum_counts *double, 7 sum2_counts *double, 8 l1 *double
CountSketch: 1 rows uint, 2 cols uint, 3 counter_type uint, 4 counts_int *sint, 5 counts_float *double, 6 l2 *double, 7 topk TopK, 16 hh_keys *string
TopK: 1 k uint, 2 entries *HeapEntry
HeapEntry: 1 key string, 2 count double
CountMinDelta: 1 rows uint, 2 cols uint, 4 l1 *double, 6 hh_keys *string, 9 cell_rows *uint, 10 cell_cols *uint, 11 d_counts *sint, 12 d_counts_float *double
CountSketchDelta: 1 rows uint, 2 cols uint, 5 topk TopK, 6 hh_keys *string, 9 cell_rows *uint, 10 cell_cols *uint, 11 d_counts *sint, 12 l2 *double, 13 d_counts_float *double
HyperLogLog: 1 variant uint, 2 precision uint, 3 registers bytes, 4 hip_kxq0 double, 5 hip_kxq1 double, 6 hip_est double, 7 registers_sparse Sparse
Sparse: 1 num_registers uint, 2 packed bytes
HLLDelta: 1 packed_updates bytes
KLL: 1 k uint, 2 m uint, 3 num_levels uint, 4 levels *uint, 5 items *double, 7 offset double, 8 value_scale sint, 9 residuals *sint
DDSketch: 1 alpha double, 2 store_counts *uint, 3 store_offset sint, 16 buckets *Bucket
Bucket: 1 index sint, 2 count uint
DDSketchDelta: 1 buckets *Bucket
Coco: 1 d uint, 2 width uint, 3 hashes *uint, 4 vals *uint, 5 has_keys *bool
Elastic: 1 bucket_count uint, 2 flow_ids *string, 3 vote_pos *sint, 4 vote_neg *sint, 5 evictions *bool, 6 light CountMin
UnivMon: 1 layer_size uint, 2 sketch_rows uint, 3 sketch_cols uint, 4 heap_size uint, 5 bucket_size uint, 6 layers *Layer
Layer: 1 sketch CountSketch, 2 heap TopK
Hydra: 1 row_num uint, 2 col_num uint, 3 counter_type uint, 4 cells *Cell, 5 big_counter Cell, 6 seed_index uint, 7 enable_topk bool, 8 fanout_subkeys bool
Cell: 1 count_min CountMin, 2 count_sketch CountSketch, 3 hll HyperLogLog, 4 kll KLL, 5 univmon UnivMon
"""
INT64, FLOAT64 = 2, 4
VARIANTS = {"regular": 1, "ertl": 2, "sparse": 2}
#: Below so many registers in use a HyperLogLog is sent sparse; a DDSketch is sent dense up to so many buckets for each in use.
SPARSE_REGISTERS, DENSE_SPAN = 6000, 64
COUNTERS = {"cm": 1, "cs": 2, "hll": 3, "kll": 4}

MESSAGES: dict[str, dict[int, tuple[str, str, bool]]] = {}
for _line in _FIELDS.strip().splitlines():
    _name, _rest = _line.split(": ")
    MESSAGES[_name] = {int(n): (name, kind.lstrip("*"), kind[0] == "*") for n, name, kind in (f.split() for f in _rest.split(", "))}
_NUMBERS = {"uint": (lambda x: varint(int(x)), lambda n: n), "int": (lambda x: varint(int(x)), lambda n: n - (1 << 64) if n >> 63 else n)}
_NUMBERS |= {"sint": (lambda x: varint(zigzag(int(x))), unzigzag), "bool": (lambda x: varint(int(x)), bool)}


def encode(message: str, value: dict) -> bytes:
    """A message of named fields; absent, empty and zero ones take no bytes."""
    out = bytearray()
    for number, (name, kind, many) in MESSAGES[message].items():
        x = value.get(name)
        if x is None or (many and not len(x)) or (not many and not isinstance(x, dict) and not x):
            continue
        if kind in _NUMBERS or kind == "double":
            pack = _NUMBERS[kind][0] if kind != "double" else lambda v: struct.pack("<d", v)
            if not many:
                out += varint(number << 3 | (1 if kind == "double" else 0)) + pack(x)
                continue
            raws = [struct.pack(f"<{len(x)}d", *x) if kind == "double" else b"".join(map(pack, x))]
        else:
            raws = [v.encode() if kind == "string" else bytes(v) if kind == "bytes" else encode(kind, v) for v in (x if many else [x])]
        for raw in raws:
            out += varint(number << 3 | 2) + varint(len(raw)) + raw
    return bytes(out)


def decode(message: str, data: bytes) -> dict:
    """Fields by name, repeated ones as lists.  Unknown fields, other wire types and cut-off input raise."""
    out: dict = {}
    at, known = 0, MESSAGES[message]

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise ValueError("the message ends within a number")
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("the message ends early")
        at += n
        return data[at - n : at]

    while at < len(data):
        tag = number()
        if tag >> 3 not in known:
            raise ValueError(f"{message} has no field {tag >> 3}")
        name, kind, many = known[tag >> 3]
        wire = tag & 7
        if wire == 2:
            raw = take(number())
            if kind == "double" and many and not len(raw) % 8:
                found = list(struct.unpack(f"<{len(raw) // 8}d", raw))
            elif kind in _NUMBERS and many:
                found = [_NUMBERS[kind][1](n) for n in _varints(raw)]
            elif kind in _NUMBERS or kind == "double":
                raise ValueError(f"{message}.{name} is no number")
            else:
                found = [raw.decode() if kind == "string" else raw if kind == "bytes" else decode(kind, raw)]
        elif wire == 1 and kind == "double":
            found = list(struct.unpack("<d", take(8)))
        elif wire == 0 and kind in _NUMBERS:
            found = [_NUMBERS[kind][1](number())]
        else:
            raise ValueError(f"{message}.{name} has another wire type")
        out[name] = out.get(name, []) + found if many else found[0]
    return out


def _varints(raw: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for b in raw:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(n)
            n = shift = 0
    if shift:
        raise ValueError("the message ends within a number")
    return out


# --- states of sketches: long rows to message fields, and back ---


def _counts(values: np.ndarray) -> dict:
    """Whole numbers as such, others as doubles."""
    if np.all(values == np.rint(values)) and np.all(np.abs(values) < 2.0**53):
        return {"counter_type": INT64, "counts_int": values.astype(np.int64).tolist()}
    return {"counter_type": FLOAT64, "counts_float": values.tolist()}


def _matrix(rows: pd.DataFrame, shape: Shape) -> np.ndarray:
    out = np.zeros((shape.rows, shape.cols))
    out[rows["a"].to_numpy(int), rows["b"].to_numpy(int)] = rows["v"]
    return out


def _linear(rows: pd.DataFrame, shape: Shape) -> dict:
    m = _matrix(rows, shape)
    norms = {"l2": (m * m).sum(axis=1).tolist()} if shape.signed else {"l1": m.sum(axis=1).tolist()}
    return {"rows": shape.rows, "cols": shape.cols, **_counts(m.ravel()), **norms}


def _linear_rows(state: dict, shape: Shape) -> list[tuple]:
    if (state.get("rows"), state.get("cols")) != (shape.rows, shape.cols):
        raise Mismatch("another shape")
    counts = state.get("counts_int") or state.get("counts_float") or []
    if counts and len(counts) != shape.rows * shape.cols:
        raise Mismatch("the counts do not fill the matrix")
    return [("cell", i // shape.cols, i % shape.cols, None, float(v), None) for i, v in enumerate(counts) if v]


def packed_registers(pairs: Iterable[tuple[int, int]]) -> bytes:
    """Ascending ``(register, value)`` as varints of the step from the register before and of the value."""
    out, before = bytearray(), 0
    for reg, value in pairs:
        out += varint(reg - before) + varint(value)
        before = reg
    return bytes(out)


def unpacked_registers(raw: bytes, most: int = M) -> list[tuple[int, int]]:
    numbers = _varints(raw)
    if len(numbers) % 2:
        raise ValueError("a register without a value")
    out, at = [], 0
    for i in range(0, len(numbers), 2):
        if i and not numbers[i]:
            raise ValueError("registers do not ascend")
        at += numbers[i]
        if at >= most or not 0 < numbers[i + 1] < 256:
            raise ValueError("no such register or value")
        out.append((at, numbers[i + 1]))
    return out


def _hll(rows: pd.DataFrame, variant: str) -> dict:
    pairs = sorted(zip(rows["a"].astype(int), rows["b"].astype(int), strict=True))
    state = {"variant": VARIANTS[variant], "precision": P}
    if len(pairs) < SPARSE_REGISTERS:
        return state | {"registers_sparse": {"num_registers": M, "packed": packed_registers(pairs)}}
    dense = bytearray(M)
    for reg, rho in pairs:
        dense[reg] = rho
    return state | {"registers": bytes(dense)}


def _hll_rows(state: dict, variant: str) -> list[tuple]:
    if state.get("variant") != VARIANTS[variant] or state.get("precision") != P:
        raise Mismatch("another variant or precision")
    if "registers" in state:
        if len(state["registers"]) != M:
            raise Mismatch("the precision does not fit the registers")
        pairs = [(i, v) for i, v in enumerate(state["registers"]) if v]
    else:
        sparse = state.get("registers_sparse", {"num_registers": M})
        if sparse.get("num_registers") != M:
            raise Mismatch("the precision does not fit the registers")
        pairs = unpacked_registers(sparse.get("packed", b""))
    return [("reg", reg, rho, None, None, None) for reg, rho in pairs]


def fixed_point(items: list[float]) -> dict | None:
    """``offset, value_scale, residuals`` by which all items come back exactly: the least item, a power of ten from 10^0 to 10^-6, whole numbers."""
    if not items or not all(map(math.isfinite, items)):
        return None
    offset = min(items)
    for scale in range(0, -7, -1):
        found = [round((v - offset) * 10.0**-scale) for v in items]
        if all(abs(r) < 1 << 63 for r in found) and all(r * 10.0**scale + offset == v for r, v in zip(found, items, strict=True)):
            return {"offset": offset, "value_scale": scale, "residuals": found}
    return None


def _kll(rows: pd.DataFrame, k: int, m: int) -> dict:
    """Items with the highest level first."""
    top = int(rows["a"].max()) if len(rows) else 0
    levels = [sorted(rows.loc[rows["a"] == level, "v"].tolist()) for level in range(top, -1, -1)]
    items = [x for level in levels for x in level]
    state = {"k": k, "m": m, "num_levels": top + 1, "levels": np.cumsum([0, *map(len, levels)]).tolist()}
    return state | (fixed_point(items) or {"items": items})


def _kll_rows(state: dict, k: int, m: int) -> list[tuple]:
    if (state.get("k"), state.get("m")) != (k, m):
        raise Mismatch("another k or m")
    items, cuts = state.get("items", []), state.get("levels", [])
    if "residuals" in state:
        items = [r * 10.0 ** state.get("value_scale", 0) + state.get("offset", 0.0) for r in state["residuals"]]
    n = state.get("num_levels", 0)
    if len(cuts) != n + 1 or cuts != sorted(cuts) or cuts[-1] != len(items):
        raise ValueError("levels do not cut the items")
    return [("item", n - 1 - i, None, None, float(x), None) for i in range(n) for x in items[cuts[i] : cuts[i + 1]]]


def _dd(rows: pd.DataFrame, alpha: float) -> dict:
    found = {int(b): int(n) for b, n in zip(rows["a"], rows["v"], strict=True) if n > 0}
    if not found:
        return {"alpha": alpha}
    low, high = min(found), max(found)
    if high - low + 1 <= DENSE_SPAN * len(found):
        return {"alpha": alpha, "store_offset": low, "store_counts": [found.get(b, 0) for b in range(low, high + 1)]}
    return {"alpha": alpha, "buckets": [{"index": b, "count": n} for b, n in sorted(found.items())]}


def _dd_rows(state: dict, alpha: float) -> list[tuple]:
    if state.get("alpha") != alpha:
        raise Mismatch("another alpha")
    low = state.get("store_offset", 0)
    pairs = [(low + i, n) for i, n in enumerate(state.get("store_counts", []))] + [(b.get("index", 0), b.get("count", 0)) for b in state.get("buckets", [])]
    return [("bucket", b, None, None, float(n), None) for b, n in pairs if n]


def _coco(rows: pd.DataFrame, d: int, width: int) -> dict:
    hashes, vals = [0] * (d * width), [0] * (d * width)
    for r, c, key, v in zip(rows["a"], rows["b"], rows["s"], rows["v"], strict=True):
        hashes[int(r) * width + int(c)], vals[int(r) * width + int(c)] = hashing.xxh3_64(key.encode()), int(v)
    return {"d": d, "width": width, "hashes": hashes, "vals": vals, "has_keys": [v > 0 for v in vals]}


def _coco_rows(state: dict, d: int, width: int) -> list[tuple]:
    if (state.get("d"), state.get("width")) != (d, width) or not len(state.get("hashes", [])) == len(state.get("vals", [])) == d * width:
        raise Mismatch("another shape")
    return [("coco", i // width, i % width, None, float(v), str(h)) for i, (h, v, has) in enumerate(zip(state["hashes"], state["vals"], state["has_keys"], strict=True)) if has]


def _elastic(rows: pd.DataFrame, buckets: int) -> dict:
    heavy = rows[rows["t"] == "heavy"]
    held = {int(a): (s, int(v), int(b), bool(c)) for a, s, v, b, c in zip(heavy["a"], heavy["s"], heavy["v"], heavy["b"], heavy["c"], strict=True)}
    flow, pos, neg, mixed = (list(x) for x in zip(*(held.get(i, ("", 0, 0, False)) for i in range(buckets)), strict=True))
    return {"bucket_count": buckets, "flow_ids": flow, "vote_pos": pos, "vote_neg": neg, "evictions": mixed, "light": _linear(rows[rows["t"] == "cell"], LIGHT)}


def _elastic_rows(state: dict, buckets: int) -> list[tuple]:
    columns = [state.get(n, []) for n in ("flow_ids", "vote_pos", "vote_neg", "evictions")]
    if state.get("bucket_count") != buckets or any(len(c) != buckets for c in columns):
        raise Mismatch("another number of buckets")
    return [("heavy", i, neg, int(mixed), float(pos), flow) for i, (flow, pos, neg, mixed) in enumerate(zip(*columns, strict=True)) if pos] + _linear_rows(state["light"], LIGHT)


def _univmon(rows: pd.DataFrame, p: Pyramid) -> dict:
    layers = []
    for layer in range(p.layers):
        here = rows[rows["a"] == layer]
        cells = here[here["t"] == "cell"].assign(a=lambda x: x["b"], b=lambda x: x["c"])
        top = here[here["t"] == "top"].sort_values(["v", "s"], ascending=[False, True])
        shape = Shape(p.rows, p.cols if layer < p.wide else p.narrow, signed=True)
        layers.append({"sketch": _linear(cells, shape), "heap": {"k": p.k, "entries": [{"key": s, "count": float(v)} for s, v in zip(top["s"], top["v"], strict=True)]}})
    total = rows.loc[rows["t"] == "total", "v"].sum()
    return {"layer_size": p.layers, "sketch_rows": p.rows, "sketch_cols": p.cols, "heap_size": p.k, "bucket_size": int(total), "layers": layers}


def _univmon_rows(state: dict, p: Pyramid) -> list[tuple]:
    if (state.get("layer_size"), state.get("sketch_rows"), state.get("sketch_cols"), state.get("heap_size"), len(state.get("layers", []))) != (p.layers, p.rows, p.cols, p.k, p.layers):
        raise Mismatch("another pyramid")
    out = [("total", None, None, None, float(state.get("bucket_size", 0)), None)]
    for i, layer in enumerate(state["layers"]):
        shape = Shape(p.rows, p.cols if i < p.wide else p.narrow, signed=True)
        out += [("cell", i, a, b, v, None) for _, a, b, _, v, _ in _linear_rows(layer["sketch"], shape)]
        out += [("top", i, None, None, e.get("count", 0.0), e.get("key", "")) for e in layer.get("heap", {}).get("entries", [])]
    return out


_HYDRA = {"cm": ("count_min", _linear, _linear_rows), "cs": ("count_sketch", _linear, _linear_rows), "hll": ("hll", _hll, _hll_rows), "kll": ("kll", _kll, _kll_rows)}


def _hydra(rows: pd.DataFrame, kind: str, depth: int, width: int, *inner: object) -> dict:
    field, make, _ = _HYDRA[kind]
    cells = {int(c): g.assign(a=g["b"], b=g["c"]) for c, g in rows.groupby("a")}
    none = rows.iloc[:0]
    return {"row_num": depth, "col_num": width, "counter_type": COUNTERS[kind], "fanout_subkeys": True, "cells": [{field: make(cells.get(i, none), *inner)} for i in range(depth * width)]}


def _hydra_rows(state: dict, kind: str, depth: int, width: int, *inner: object) -> list[tuple]:
    field, _, read = _HYDRA[kind]
    if (state.get("row_num"), state.get("col_num"), state.get("counter_type"), len(state.get("cells", []))) != (depth, width, COUNTERS[kind], depth * width):
        raise Mismatch("another grid")
    return [(t, i, a, b, v, s) for i, cell in enumerate(state["cells"]) for t, a, b, _, v, s in read(cell[field], *inner)]


#: The envelope's field of each sketch, and how its state is made and read.
STATES: dict[str, tuple[str, Callable, Callable]] = {
    "cm": ("count_min", _linear, _linear_rows), "cs": ("count_sketch", _linear, _linear_rows), "hll": ("hll", _hll, _hll_rows), "kll": ("kll", _kll, _kll_rows), "dd": ("ddsketch", _dd, _dd_rows),
    "coco": ("coco", _coco, _coco_rows), "elastic": ("elastic", _elastic, _elastic_rows), "univmon": ("univmon", _univmon, _univmon_rows), "hydra": ("hydra", _hydra, _hydra_rows),
}
TYPES = {"count_min": "CountMin", "count_sketch": "CountSketch", "hll": "HyperLogLog", "kll": "KLL", "ddsketch": "DDSketch", "coco": "Coco", "elastic": "Elastic", "univmon": "UnivMon", "hydra": "Hydra"}


# --- sketches as tables of messages ---

_LONG = {"t": "string", "a": "int", "b": "int", "c": "int", "v": "double", "s": "string"}
LONG = ", ".join(f"{c} {k}" for c, k in _LONG.items())


def _long(df: DataFrame, by: list[str], t: str, **columns: str) -> DataFrame:
    return df.select(*by, *((F.lit(t) if c == "t" else F.expr(columns[c]) if c in columns else F.lit(None)).cast(k).alias(c) for c, k in _LONG.items()))


def _rows_of(sketch: object) -> tuple[str, tuple, list[str], DataFrame]:
    """``(kind, parameters, by, long rows)`` of a sketch."""
    by = [] if isinstance(sketch, Elastic) else as_list(sketch.by)
    cells = lambda df, **c: _long(df, by, "cell", a="row", b="col", v="v", **c)
    if isinstance(sketch, Linear):
        return "cs" if sketch.shape.signed else "cm", (sketch.shape,), by, cells(sketch.cells)
    if isinstance(sketch, HLL):
        return "hll", (sketch.variant,), by, _long(sketch.registers, by, "reg", a="reg", b="rho")
    if isinstance(sketch, KLL):
        return "kll", (sketch.k, sketch.m), by, _long(sketch.items, by, "item", a="level", v="item")
    if isinstance(sketch, DDSketch):
        return "dd", (sketch.mapping.alpha,), by, _long(sketch.buckets, by, "bucket", a="bucket", v="cnt")
    if isinstance(sketch, Coco):
        return "coco", (sketch.rows, sketch.cols), by, _long(sketch.table, by, "coco", a="row", b="col", s="key", v="val")
    if isinstance(sketch, Elastic):
        heavy = _long(sketch.heavy, by, "heavy", a="bucket", b="vote_neg", c="mixed", v="vote_pos", s="flow")
        return "elastic", (sketch.buckets,), by, heavy.unionByName(cells(sketch.light.cells))
    if isinstance(sketch, UnivMon):
        tables = [_long(sketch.cells, by, "cell", a="layer", b="row", c="col", v="v"), _long(sketch.top, by, "top", a="layer", s="key", v="cnt"), _long(sketch.total, by, "total", v="total")]
        return "univmon", (sketch.pyramid,), by, reduce(DataFrame.unionByName, tables)
    if isinstance(sketch, Hydra) and sketch.kind in _HYDRA:
        kind, inner, _, rows = _rows_of(sketch.inner)
        at = F.col("grid_row") * sketch.width + F.col("grid_col")
        return "hydra", (kind, sketch.depth, sketch.width, *inner), by, rows.select(*by, "t", at.alias("a"), F.col("a").alias("b"), F.col("b").alias("c"), "v", "s")
    raise TypeError(f"no message for {type(sketch).__name__}")


def _messages(rows: DataFrame, by: list[str], make: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in by)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*(group[b].iloc[0] for b in by), make(group))], columns=[*by, "data"])

    return each_group(rows.withColumn("_g", F.lit(0)), [*by, "_g"], one, f"{kinds}data binary")


def _read(messages: DataFrame, by: list[str], read: Callable[[bytes], list[tuple]]) -> DataFrame:
    kinds = "".join(f"{c} {messages.schema[c].dataType.simpleString()}, " for c in by)

    def rows(batches):
        for batch in batches:
            out = [(*(row[b] for b in by), *x) for row in batch.to_dict("records") for x in read(bytes(row["data"]))]
            made = pd.DataFrame(out, columns=[*by, *_LONG])
            yield made.astype({"a": "Int32", "b": "Int32", "c": "Int32", "v": "Float64"})

    return messages.select(*by, "data").mapInPandas(rows, kinds + LONG)


def to_messages(sketch: object, sample_p: float | None = None) -> DataFrame:
    """``(*by, data)``: an envelope of each group's sketch.  A sampling rate below 1 travels with it."""
    kind, parameters, by, rows = _rows_of(sketch)
    field, make, _ = STATES[kind]
    p = sample_p if sample_p is not None else sketch.shape.sample_p if isinstance(sketch, Linear) else getattr(sketch, "sample_p", 1.0)
    head = {"format_version": 1, "producer": {"library": "cellmesh", "version": "1"}, "sample_p": p if p < 1 else None}
    return _messages(rows, by, lambda group: encode("Envelope", head | {field: make(group, *parameters)}))


def from_messages(messages: DataFrame, like: object) -> object:
    """The sketch in ``(*by, data)``, of the type and parameters of ``like``, whose tables are not read.

    What the format does not hold follows from what it does: counts of KLL and scalars of DDSketch.  Coco's keys come back as the decimal XXH3 hashes that stand for them.
    """
    kind, parameters, by, _ = _rows_of(like)
    field, _, read = STATES[kind]

    def rows_of(data: bytes) -> list[tuple]:
        envelope = decode("Envelope", data)
        if envelope.get("format_version") != 1 or field not in envelope:
            raise Mismatch(f"no {field} in the envelope")
        return read(envelope[field], *parameters)

    return _sketch(_read(messages, by, rows_of), by, like)


def _sketch(rows: DataFrame, by: list[str], like: object) -> object:
    part = lambda t, *columns: rows.where(F.col("t") == t).selectExpr(*by, *columns)
    cells = lambda: part("cell", "a AS row", "b AS col", "v")
    if isinstance(like, Linear):
        return replace(like, cells=cells())
    if isinstance(like, HLL):
        return replace(like, registers=part("reg", "a AS reg", "b AS rho"))
    if isinstance(like, KLL):
        items = part("item", "a AS level", "v AS item")
        return replace(like, items=items, counts=items.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), F.col("level"))).cast("bigint").alias("n")))
    if isinstance(like, DDSketch):
        return DDSketch.from_buckets(part("bucket", "a AS bucket", "cast(v as bigint) AS cnt"), by, like.mapping.alpha)
    if isinstance(like, Coco):
        return replace(like, table=part("coco", "a AS row", "b AS col", "s AS key", "cast(v as bigint) AS val"))
    if isinstance(like, Elastic):
        heavy = part("heavy", "a AS bucket", "s AS flow", "cast(v as bigint) AS vote_pos", "cast(b as bigint) AS vote_neg", "c = 1 AS mixed")
        return replace(like, heavy=heavy, light=replace(like.light, cells=cells()))
    if isinstance(like, UnivMon):
        top = part("top", "a AS layer", "s AS key", "cast(v as bigint) AS cnt")
        return replace(like, cells=part("cell", "a AS layer", "b AS row", "c AS col", "cast(v as bigint) AS v"), top=top, total=part("total", "cast(v as bigint) AS total"))
    grid = rows.selectExpr(*by, f"cast(a div {like.width} as int) AS grid_row", f"a % {like.width} AS grid_col", "t", "b AS a", "c AS b", "cast(null as int) AS c", "v", "s")
    return replace(like, inner=_sketch(grid, [*by, *GRID], like.inner))


# --- the same as MessagePack frames ---

_NAMES = {"ertl": "Datafusion", "sparse": "Datafusion", "regular": "Regular"}


def _hll_array(rows: pd.DataFrame, variant: str) -> bytes:
    registers = np.zeros(M, int)
    registers[rows["a"].to_numpy(int)] = rows["b"].to_numpy(int)
    return codecs.hll_frame(_NAMES[variant], registers.tolist())


def _hll_array_rows(data: bytes, variant: str) -> list[tuple]:
    name, registers = codecs.hll_registers(data)
    if name != _NAMES[variant] or len(registers) != M:
        raise Mismatch("another variant or precision")
    return [("reg", i, v, None, None, None) for i, v in enumerate(registers) if v]


def _matrix_rows(matrix: list[list[float]], shape: Shape) -> list[tuple]:
    if (len(matrix), len(matrix[0]) if matrix else 0) != (shape.rows, shape.cols):
        raise Mismatch("another shape")
    return [("cell", r, c, None, float(v), None) for r, line in enumerate(matrix) for c, v in enumerate(line) if v]


def _dd_array_rows(data: bytes, alpha: float) -> list[tuple]:
    found, buckets = codecs.dd_buckets(data)
    if found != alpha:
        raise Mismatch("another alpha")
    return [("bucket", b, None, None, float(n), None) for b, n in buckets.items()]


ARRAYS: dict[str, tuple[Callable, Callable]] = {
    "cm": (lambda rows, shape: codecs.cm_frame(_matrix(rows, shape).tolist(), False), lambda data, shape: _matrix_rows(codecs.cm_matrix(data, False), shape)),
    "cs": (lambda rows, shape: codecs.cm_frame(_matrix(rows, shape).tolist(), True), lambda data, shape: _matrix_rows(codecs.cm_matrix(data, True), shape)),
    "hll": (_hll_array, _hll_array_rows),
    "dd": (lambda rows, alpha: codecs.dd_frame(alpha, {int(b): int(n) for b, n in zip(rows["a"], rows["v"], strict=True)}), _dd_array_rows),
}


def to_arrays(sketch: object) -> DataFrame:
    """``(*by, data)``: the positional frame of each group's Count-Min, Count-Sketch, HyperLogLog or DDSketch."""
    kind, parameters, by, rows = _rows_of(sketch)
    if kind not in ARRAYS:
        raise TypeError(f"no frame of {kind}")
    return _messages(rows, by, lambda group: ARRAYS[kind][0](group, *parameters))


def from_arrays(frames: DataFrame, like: object) -> object:
    kind, parameters, by, _ = _rows_of(like)
    return _sketch(_read(frames, by, lambda data: ARRAYS[kind][1](data, *parameters)), by, like)


def tracked_frame(sketch: Tracked, before: Tracked | None = None) -> DataFrame:
    """One row ``data``: cells and heaviest keys; against ``before`` the changed cells, whole numbers, and all keys.

    A sketch that tracks every key has further rows, frames of keys and of no cells: none takes more than ``k`` keys, 256 at least.
    """
    shape, k, whole = sketch.sketch.shape, sketch.k, before is None
    heap = dealt(sketch.estimates().withColumn("rk", F.lit(0)), "key", max(k, 256)) if sketch.every else sketch.top_k().withColumn("_deal", F.lit(0))
    cells = sketch.sketch.cells if before is None else sketch.sketch.delta(before.sketch).withColumnRenamed("d", "v")
    cells, by = cells.withColumn("_deal", F.lit(0)), ["_deal"]
    rows = _long(cells, by, "cell", a="row", b="col", v="v").unionByName(_long(heap, by, "key", a="rk", s="key", v="cnt"))

    def make(group: pd.DataFrame) -> bytes:
        keys, own = group[group["t"] == "key"].sort_values(["a", "v", "s"], ascending=[True, False, True]), group[group["t"] == "cell"].sort_values(["a", "b"])
        heaviest = list(zip(keys["s"], keys["v"], strict=True))
        if whole and not group["_deal"].iloc[0]:
            return codecs.heap_frame(_matrix(own, shape).tolist(), heaviest, k)
        return codecs.heap_delta_frame(shape.rows, shape.cols, zip(own["a"].astype(int).tolist(), own["b"].astype(int).tolist(), own["v"].astype(int).tolist(), strict=True), heaviest, k)

    return _messages(rows, by, make).select("data")


def read_tracked(frames: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """``(row, col, v)`` and ``(key, cnt)`` of frames of either form; the first bytes tell which."""

    def read(data: bytes) -> list[tuple]:
        if codecs.is_delta(data):
            rows, cols, cells, heap, _ = codecs.heap_delta_values(data)
            if (rows, cols) != (shape.rows, shape.cols):
                raise Mismatch("another shape")
            out = [("cell", r, c, None, float(v), None) for r, c, v in cells]
        else:
            matrix, heap, _ = codecs.heap_values(data)
            out = _matrix_rows(matrix, shape)
        return out + [("key", None, None, None, float(v), k) for k, v in heap]

    rows = _read(frames, [], read)
    return rows.where("t = 'cell'").selectExpr("a AS row", "b AS col", "v"), rows.where("t = 'key'").selectExpr("s AS key", "cast(v as bigint) AS cnt")


def delta_arrays(kind: str, delta: DataFrame, shape: Shape | None = None) -> DataFrame:
    """One row ``data``: changed cells ``[rows, cols, rows, columns, changes]``, registers ``[registers, values]`` or buckets ``[buckets, changes]``."""

    def make(rows: pd.DataFrame) -> bytes:
        rows = rows.sort_values(["a", "b"])
        a = rows["a"].astype(int).tolist()
        if kind == "hll":
            return codecs.columns_frame(a, rows["b"].astype(int).tolist())
        v = rows["v"].tolist()
        whole = [int(x) for x in v] if all(float(x).is_integer() for x in v) else v
        return codecs.columns_frame(a, whole) if kind == "dd" else codecs.cell_delta_frame(shape.rows, shape.cols, zip(a, rows["b"].astype(int).tolist(), whole, strict=True))

    return _messages(delta_rows(kind, delta), [], make)


def read_delta_arrays(kind: str, frames: DataFrame, shape: Shape | None = None) -> DataFrame:
    def read(data: bytes) -> list[tuple]:
        if kind in ("hll", "dd"):
            pairs = codecs.columns_values(data, 2)
            return [("reg", a, b, None, None, None) if kind == "hll" else ("bucket", a, None, None, float(b), None) for a, b in pairs]
        rows, cols, cells = codecs.cell_delta_values(data)
        if (rows, cols) != (shape.rows, shape.cols):
            raise Mismatch("another shape")
        return [("cell", a, b, None, float(v), None) for a, b, v in cells]

    rows = _read(frames, [], read)
    return rows.selectExpr(*{"hll": ("a AS reg", "b AS rho"), "dd": ("a AS bucket", "cast(v as bigint) AS d")}.get(kind, ("a AS row", "b AS col", "v AS d")))


# --- deltas ---

DELTAS = {"cm": ("count_min", "CountMinDelta"), "cs": ("count_sketch", "CountSketchDelta"), "hll": ("hll", "HLLDelta"), "dd": ("ddsketch", "DDSketchDelta")}


def delta_rows(kind: str, delta: Delta | DataFrame) -> DataFrame:
    """Long rows of a delta, by the message ``_deal`` if keys go into several: cells with, where there are, row masses and keys; registers; or buckets."""
    if kind == "hll":
        return _long(delta, [], "reg", a="reg", b="rho")
    if kind == "dd":
        return _long(delta, [], "bucket", a="bucket", v="d")
    if not isinstance(delta, Delta):
        return _long(delta, [], "cell", a="row", b="col", v="d")
    by, cells, l1, keys = [], delta.cells, delta.l1, delta.keys
    if delta.k is not None:
        by, keys = ["_deal"], dealt(keys, "key", max(delta.k, 256))
        cells, l1 = (t.withColumn("_deal", F.lit(0)) for t in (cells, l1))
    return _long(cells, by, "cell", a="row", b="col", v="d").unionByName(_long(l1, by, "l1", a="row", v="d")).unionByName(_long(keys, by, "key", s="key"))


def delta_message(kind: str, delta: Delta | DataFrame, shape: Shape | None = None, partition_key: str = "", window_start_ms: int = 0, closed: bool = False) -> DataFrame:
    """One row ``data``: an envelope of the delta.  A delta of nothing has no row; one of every key has further rows, envelopes of keys alone."""
    field, name = DELTAS[kind]
    head = {"partition_key": partition_key, "window_start_ms": window_start_ms, "is_window_close": closed}

    def make(rows: pd.DataFrame) -> bytes:
        if kind == "hll":
            state = {"packed_updates": packed_registers(sorted(zip(rows["a"].astype(int), rows["b"].astype(int), strict=True)))}
        elif kind == "dd":
            state = {"buckets": [{"index": int(b), "count": int(n)} for b, n in sorted(zip(rows["a"], rows["v"], strict=True))]}
        else:
            cells, l1 = rows[rows["t"] == "cell"].sort_values(["a", "b"]), rows[rows["t"] == "l1"]
            d = cells["v"].to_numpy()
            whole = bool(np.all(d == np.rint(d)) and np.all(np.abs(d) < 2.0**53))
            masses = np.zeros(shape.rows)
            masses[l1["a"].to_numpy(int)] = l1["v"]
            state = {"rows": shape.rows, "cols": shape.cols, "cell_rows": cells["a"].tolist(), "cell_cols": cells["b"].tolist(), "d_counts" if whole else "d_counts_float": d.tolist()}
            state |= {"hh_keys": sorted(rows.loc[rows["t"] == "key", "s"]), **({"l1": masses.tolist()} if kind == "cm" and len(l1) else {})}
        return encode("DeltaEnvelope", head | {field: state})

    return _messages(delta_rows(kind, delta), ["_deal"] if isinstance(delta, Delta) and delta.k is not None else [], make).select("data")


def read_delta(kind: str, messages: DataFrame, shape: Shape | None = None) -> Delta | DataFrame:
    """What :func:`delta_message` was made of."""
    field, _ = DELTAS[kind]

    def read(data: bytes) -> list[tuple]:
        state = decode("DeltaEnvelope", data).get(field)
        if state is None:
            raise Mismatch(f"no {field} in the envelope")
        if kind == "hll":
            return [("reg", reg, rho, None, None, None) for reg, rho in unpacked_registers(state.get("packed_updates", b""))]
        if kind == "dd":
            return [("bucket", b.get("index", 0), None, None, float(b.get("count", 0)), None) for b in state.get("buckets", [])]
        if (state.get("rows"), state.get("cols")) != (shape.rows, shape.cols):
            raise Mismatch("another shape")
        d = state.get("d_counts") or state.get("d_counts_float") or []
        cells = [("cell", a, b, None, float(v), None) for a, b, v in zip(state.get("cell_rows", []), state.get("cell_cols", []), d, strict=True)]
        return cells + [("l1", i, None, None, v, None) for i, v in enumerate(state.get("l1", []))] + [("key", None, None, None, None, s) for s in state.get("hh_keys", [])]

    rows = _read(messages, [], read)
    part = lambda t, *columns: rows.where(F.col("t") == t).selectExpr(*columns)
    if kind == "hll":
        return part("reg", "a AS reg", "b AS rho")
    if kind == "dd":
        return part("bucket", "a AS bucket", "cast(v as bigint) AS d")
    return Delta(part("cell", "a AS row", "b AS col", "v AS d"), part("l1", "a AS row", "v AS d"), part("key", "s AS key"))
