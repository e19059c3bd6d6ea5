"""Quality rules: counts over words and lines, and bands of compressibility.

Text that repeats itself compresses too well, random strings hardly at all.  Zstandard ratios (compressed bytes over bytes) of the
whole document and of its fixed chunks must lie in a band that depends on the length compressed.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .text import NON_SPACE, buffers, byte_class, chunks, grams, looked_up, words

LEVEL = 3
CHUNK = 4096
WINDOW = 5
#: Least length in bytes, and the ratios between which text of that length and more passes.  Prose lies well inside: frames
#: alone take 13 bytes, so short texts have no bounds or wide ones.
BANDS = (
    (0, 0.0, float("inf")),
    (64, 0.30, float("inf")),
    (128, 0.28, 1.00),
    (256, 0.26, 0.92),
    (512, 0.24, 0.84),
    (1024, 0.22, 0.76),
    (2048, 0.20, 0.72),
    (8192, 0.18, 0.70),
    (65536, 0.16, 0.70),
)
#: Of a document's chunks so many may lie outside the band of their length.
BAD_SHARE = 0.25

SYMBOLS = byte_class(*((c, c) for c in b"#*$%&|<>"))  # 0 at symbols
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SIZES = ["n_bytes", "whole_bytes", "whole_side", "n_chunks", "low_chunks", "high_chunks"]


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Set flags of each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def repeated_words(h: np.ndarray) -> int:
    """Words inside windows of ``WINDOW`` words that occur twice or more in ``h``, the hashes of a text's words."""
    g = grams(h, WINDOW)
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    edge[: len(g)] += twice
    edge[WINDOW : WINDOW + len(g)] -= twice
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


class Rules:
    """Counts and compressed sizes of texts."""

    def __init__(self, level: int = LEVEL, chunk: int = CHUNK, bands: tuple = BANDS):
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.chunk, self.bands = chunk, bands

    def compressed(self, data: bytes) -> int:
        return len(self.zstd.compress(data))

    def side(self, n: int, size: int) -> int:
        """-1 below the band of length ``n``, 1 above, else 0."""
        _, low, high = self.bands[bisect.bisect_right(self.bands, n, key=lambda b: b[0]) - 1]
        return -1 if size < low * n else int(size > high * n)

    def sizes(self, text: bytes) -> list[int]:
        """``SIZES``: a last piece shorter than a chunk counts with the chunk before it."""
        whole, n = self.compressed(text), max(len(text) // self.chunk, 1)
        cuts = [*range(0, n * self.chunk, self.chunk), len(text)]
        sides = [self.side(b - a, self.compressed(text[a:b]) if n > 1 else whole) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return [len(text), whole, self.side(len(text), whole), n, sides.count(-1), sides.count(1)]

    def rows(self, column: pa.Array) -> list[list[int]]:
        data, offs = buffers(column)
        h, _, _, off = words(data, offs, NON_SPACE, lower=False)
        inside = (looked_up(data, NON_SPACE) != 0) & ((data & 0xC0) != 0x80)
        chars, symbols = per_text(inside, offs), per_text(looked_up(data, SYMBOLS) == 0, offs)
        out = []
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            text = data[offs[i] : offs[i + 1]].tobytes()
            out.append([b - a, int(chars[i]), int(symbols[i]), repeated_lines(text), repeated_words(h[a:b]), *self.sizes(text)])
        return out


def measured(docs: DataFrame, text: str = "text", level: int = LEVEL, chunk: int = CHUNK, bands: tuple = BANDS) -> DataFrame:
    """``docs`` with ``COUNTS`` and ``SIZES``; a column with a name of these is kept as ``<name>_in``.  Null text counts as empty."""
    others = {c: c for c in docs.columns}
    for c in others:
        while others[c] in (*COUNTS, *SIZES) or (others[c] != c and others[c] in docs.columns):
            others[c] += "_in"
    at = docs.columns.index(text)
    kind = StructType([*(StructField(others[f.name], f.dataType) for f in docs.schema), *(StructField(c, LongType()) for c in (*COUNTS, *SIZES))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Rules(level, chunk, bands)
        for batch in chunks(batches, text):
            columns = [pa.array(c, pa.int64()) for c in zip(*own.rows(batch.column(at)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=kind.names)

    return docs.mapInArrow(run, kind)


def base_failed() -> Column:
    """Fewer than 10 words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(bad_share: float = BAD_SHARE) -> Column:
    """``low`` or ``high`` for text below or above its bands, ``ok`` else; the whole document comes first."""
    share = lambda c: F.col(c) > bad_share * F.col("n_chunks")
    low, high = (F.col("whole_side") < 0) | share("low_chunks"), (F.col("whole_side") > 0) | share("high_chunks")
    return F.when(low, "low").when(high, "high").otherwise("ok")


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``COUNTS``, ``SIZES``, ``base_failed``, ``verdict`` and ``kept``.

    Null and empty texts have no words and fail.  Each row is judged alone: ties and repeated rows get the same verdict.  Whole texts are
    counted and compressed, of any length; an empty table gives no rows.  Repeated windows are found by 64-bit hashes.
    """
    rows = measured(docs, text).withColumns({"base_failed": base_failed(), "verdict": verdict()})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("verdict") == "ok"))


def select(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the same columns."""
    own = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col(text).alias("body"))
    return judged(own, "body").where("kept").select("row.*")
