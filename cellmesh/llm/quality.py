"""Quality by ordinal cumulative-link regression on hashed text.

One weight vector over hashed features is shared by all grades; grade k is reached where the score passes the
k-th of the ordered thresholds: ``P(grade > k) = 1 / (1 + exp(threshold[k] - score))``.  A document's score is the
mean of its words' weights: a word counts by itself, by its shape (its first and last bytes and case) and by
whether it repeats the word before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled
from .text import NON_SPACE, U64, buffers, chunks, looked_up, mix, words

BITS = 16
#: Rows of each grade that a model learns from at most.
PER_GRADE = 3000
#: Byte classes of a word's ends: control and space, digit, upper, lower, each punctuation mark, other bytes.
SHAPE = bytes(1 if 48 <= c < 58 else 2 if 65 <= c < 91 else 3 if 97 <= c < 123 else c if 32 < c < 128 else 4 if c > 127 else 0 for c in range(256))


def features(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature numbers of each word, several arrays, and the words' offsets by text."""
    data, offs = buffers(column)
    h, start, end, off = words(data, offs, NON_SPACE)
    if not len(h):
        return [np.zeros(0, np.int64)] * 3, off
    shape = looked_up(data, SHAPE).astype(np.int64)
    second = np.minimum(start + 1, end - 1)
    before = np.maximum(end - 2, start)
    code = ((shape[start] * 128 + shape[second]) * 128 + shape[before]) * 128 + shape[end - 1]
    shaped = mix(code.astype(U64) + U64(1) << U64(8))
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[off[:-1][off[:-1] < len(h)]] = False
    down = U64(64 - BITS)
    word = (h >> down).astype(np.int64)
    return [word, (1 << BITS) + (shaped >> down).astype(np.int64), (2 << BITS) + again.astype(np.int64)], off


SIZE = (2 << BITS) + 2


def means(parts: list[np.ndarray], off: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The mean weight of each text's words; 0 without words."""
    n = np.diff(off)
    total = np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        v = weights[parts[0]]
        for p in parts[1:]:
            v = v + weights[p]
        total[full] = np.add.reduceat(v, off[:-1][full]) / n[full]
    return total


def counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(pairs, off, n)``: the distinct features of each text with their counts, their offsets by text, and each text's number of words."""
    parts, off = features(column)
    n = np.diff(off)
    doc = np.repeat(np.arange(len(n)), n)
    code, count = np.unique(np.concatenate([doc * SIZE + p for p in parts]), return_counts=True)
    return np.stack([code % SIZE, count], axis=1).astype(np.int32), np.searchsorted(code, np.arange(len(n) + 1) * SIZE), n


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pairs`` and ``words`` as :func:`counted` has them in the place of ``text``: the driver gets no texts."""
    from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

    kept = [c for c in docs.columns if c != "text"]
    schema = StructType([*(docs.schema[c] for c in kept), StructField("pairs", BinaryType()), StructField("words", IntegerType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            pairs, off, n = counted(batch.column("text"))
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((off * 8).astype(np.int32)), pa.py_buffer(pairs)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), packed, pa.array(n, pa.int32())], [*kept, "pairs", "words"])

    return docs.mapInArrow(rows, schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[dict], rounds: int = 150, rate: float = 0.5, decay: float = 1e-5) -> dict:
    """Weights and thresholds from ``label, total`` rows with ``text`` or its ``pairs, words``, by full-batch Adam.

    Classes weigh as their totals, so a bounded sample leaves probabilities as they are.  Without rows, or with one grade,
    there is nothing to tell apart: every text has the top grade.
    """
    grades = sorted({r["label"] for r in rows})
    if len(grades) < 2:
        return {"grades": grades or [1], "weights": np.zeros(SIZE), "thresholds": np.full(max(0, len(grades) - 1), -40.0)}
    y = np.searchsorted(grades, [r["label"] for r in rows])
    share = np.array([r["total"] for r in rows], float) / np.bincount(y)[y]
    share /= share.sum()
    # The distinct features of each text with their share of its words, some texts at a time.
    found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(rows), 100):
        some = rows[a : a + 100]
        if "pairs" in some[0]:
            each = [np.frombuffer(r["pairs"], np.int32).reshape(-1, 2) for r in some]
            pairs, held, n = np.concatenate(each), np.array([len(p) for p in each]), np.array([r["words"] for r in some])
        else:
            pairs, off, n = counted(pa.array([r["text"] for r in some], pa.large_string()))
            held = np.diff(off)
        doc = np.repeat(np.arange(len(some), dtype=np.int32), held)
        found.append((a, doc, pairs[:, 0].copy(), pairs[:, 1] / np.maximum(1, n)[doc]))
    k = len(grades) - 1
    prior = np.array([share[y > j].sum() for j in range(k)])
    base = -np.log(prior / (1 - prior))
    x = np.zeros(SIZE + k)
    x[SIZE], x[SIZE + 1 :] = base[0], np.log(np.maximum(1e-3, np.diff(base)))
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        _, g = loss(x, found, y, share, decay)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
    return {"grades": grades, "weights": x[:SIZE].astype(np.float32), "thresholds": ordered(x)}


def ordered(x: np.ndarray) -> np.ndarray:
    """Thresholds from their parameters, behind the weights: the first, and the logarithms of the steps to the others."""
    return x[SIZE] + np.concatenate([[0], np.cumsum(np.exp(x[SIZE + 1 :]))])


def loss(x: np.ndarray, found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, share: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """The weighted negative log likelihood of grades ``y`` with ``decay`` on squared weights, and its gradient.

    ``found``: blocks of texts as the number of the first, and each entry's text within the block, feature and share of its words.
    """
    k = len(x) - SIZE
    s = np.zeros(len(y))
    for a, doc, feature, value in found:
        s[a : a + 100] = np.bincount(doc, value * x[feature], min(100, len(y) - a))
    cut = ordered(x)
    p = sigmoid(s[:, None] - np.concatenate([[-np.inf], cut, [np.inf]])[None, :])  # P(grade >= j), 1 first, 0 last
    i = np.arange(len(y))
    hi, lo = p[i, y], p[i, y + 1]
    mass = np.maximum(hi - lo, 1e-12)
    d_hi, d_lo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
    d_s = share * (d_hi - d_lo)  # of the log likelihood
    g = np.zeros_like(x)
    for a, doc, feature, value in found:
        np.add.at(g, feature, value * d_s[a + doc])
    g_cut = np.zeros(k)
    np.add.at(g_cut, y[y > 0] - 1, -(share * d_hi)[y > 0])
    np.add.at(g_cut, y[y < k], (share * d_lo)[y < k])
    g[SIZE] = g_cut.sum()
    g[SIZE + 1 :] = np.cumsum(g_cut[::-1])[::-1][1:] * np.exp(x[SIZE + 1 :])
    g = decay * np.concatenate([x[:SIZE], np.zeros(k)]) - g
    return float(decay / 2 * (x[:SIZE] ** 2).sum() - (share * np.log(mass)).sum()), g


def score(docs: DataFrame, uri: str, text: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs``, all columns kept, with a struct column ``name`` of ``expected_grade`` and ``tail_probability``.

    ``tail_probability`` is that of the top grade.  Whole texts are scored; null and empty texts have the score 0 before thresholds.
    """
    from pyspark.sql.types import StructField, StructType

    k = docs.columns.index(text)
    kind = pa.struct([("expected_grade", pa.float64()), ("tail_probability", pa.float64())])
    spark_kind = "struct<expected_grade:double,tail_probability:double>"
    schema = StructType([*docs.schema.fields, StructField(name, docs.sparkSession.createDataFrame([], f"x {spark_kind}").schema["x"].dataType)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = labelled.load(uri)
        grades = np.array(model["grades"], float)
        for batch in chunks(batches, text):
            s = means(*features(batch.column(k)), model["weights"])
            tail = sigmoid(s[:, None] - model["thresholds"][None, :])
            expected = grades[0] + (tail * np.diff(grades)[None, :]).sum(axis=1)
            top = tail[:, -1] if tail.shape[1] else np.ones(len(s))
            out = pa.StructArray.from_arrays([pa.array(expected), pa.array(top)], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, name])

    return docs.mapInArrow(rows, schema)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", per_grade: int = PER_GRADE, learn: Column | None = None, learn_bytes: int = labelled.LEARN_BYTES, sample_bytes: int = labelled.SAMPLE_BYTES
) -> str:
    """Fit on at most ``per_grade`` labelled rows of each grade; the model's URI.

    The sample's texts have at most ``learn_bytes`` bytes each and ``sample_bytes`` together.  Of documents that repeat an id one is
    learned from.  Rows without id, label or text teach nothing; other columns are not read.
    """
    rows = labelled.sample(docs, labels, label, per_grade, learn, (), counts, learn_bytes, sample_bytes)
    return labelled.save(docs.sparkSession, fit(rows), "quality")


def select(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose probability of the top grade is ``least`` or more, with their own columns."""
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    scored = score(docs, train(docs, labels), name=name)
    return scored.where(F.col(f"{name}.tail_probability") >= least).drop(name)
