"""Toxicity by a convolutional text classifier in numpy.

Words map to hashed embeddings (of the word, and of its first bytes), filters of several widths slide over
them, each filter's largest response over the whole text is kept, and a logistic layer reads these.
Thresholds are calibrated by language on all labelled rows that the filters did not learn from; scores never see a language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import labelled
from .shared import new_folder, stash
from .text import ALNUM, U64, buffers, chunks, words

BITS, DIM, FILTERS, WIDTHS, PREFIX = 16, 8, 8, (1, 2, 3), 5
#: Rows of each label that a model learns from at most.
PER_CLASS = 3000
DEFAULT_THRESHOLD = 0.3
#: The thresholds to choose from.
GRID = [round(0.05 * k, 2) for k in range(1, 20)]
PAD = 2 << BITS  # the last row of the embeddings: zeros


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, off)``: two embedding rows of each word, with padding behind each text, and the texts' offsets."""
    data, offs = buffers(column)
    h, _, _, off, head = words(data, offs, ALNUM, PREFIX)
    gap = max(WIDTHS) - 1
    out = np.full((len(h) + gap * (len(off) - 1), 2), PAD, np.int64)
    at = np.arange(len(h)) + gap * np.repeat(np.arange(len(off) - 1), np.diff(off))
    out[at, 0] = (h >> U64(64 - BITS)).astype(np.int64)
    out[at, 1] = (1 << BITS) + (head >> U64(64 - BITS)).astype(np.int64)
    return out, off + gap * np.arange(len(off))


def start_model(seed: int = 5) -> dict:
    r = np.random.default_rng(seed)
    table = (r.standard_normal((PAD + 1, DIM)) * 0.1).astype(np.float32)
    table[PAD] = 0
    return {
        "table": table,
        "filters": [(r.standard_normal((w * DIM, FILTERS)) * (0.5 / np.sqrt(w))).astype(np.float32) for w in WIDTHS],
        "bias": [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        "out": np.zeros(FILTERS * len(WIDTHS), np.float32),
        "out_bias": np.float32(0),
        "scale": (1.0, 0.0),
        "thresholds": None,
        "learned": np.zeros(0, np.int64),
    }


def forward(model: dict, rows: np.ndarray, off: np.ndarray, where: bool = False):
    """Pooled responses of each text, and with ``where`` the word at which each was largest (-1: nowhere above 0)."""
    table = model["table"]
    x = (table[rows[:, 0]] + table[rows[:, 1]]).astype(model["bias"][0].dtype, copy=False)
    n = np.diff(off) - (max(WIDTHS) - 1)
    full = np.flatnonzero(n)
    pooled = np.zeros((len(n), FILTERS * len(WIDTHS)), x.dtype)
    spots = np.full(pooled.shape, -1, np.int64)
    if not len(full):
        return pooled, spots, x
    starts = off[:-1][full]
    pads = rows[:, 0] == PAD
    for k, w in enumerate(WIDTHS):
        f = model["filters"][k].reshape(w, DIM, FILTERS)
        y = x @ f[0]
        for j in range(1, w):
            y[:-j] += x[j:] @ f[j]
        y += model["bias"][k]
        np.maximum(y, 0, out=y)
        y[pads] = 0
        best = np.maximum.reduceat(y, starts, axis=0)
        part = slice(k * FILTERS, (k + 1) * FILTERS)
        pooled[full, part] = best
        if where:
            for t, a, b in zip(full.tolist(), off[:-1][full].tolist(), off[1:][full].tolist(), strict=True):
                i = y[a:b].argmax(axis=0)
                spots[t, part] = np.where(pooled[t, part] > 0, i + a, -1)
    return pooled, spots, x


def on_grid(values: np.ndarray, bits: int = 20) -> tuple[np.ndarray, int]:
    """Values rounded to multiples of a power of two that leaves the largest some ``bits`` bits, and that power."""
    power = int(np.frexp(np.abs(values).max(initial=0))[1]) - bits
    return np.ldexp(np.rint(np.ldexp(values.astype(np.float64), -power)), power), power


def settled(model: dict) -> None:
    """Round parameters so that all sums in :func:`forward` are exact in doubles: 22 bits times 21 bits, 24 times.

    Exact sums come out alike in any order, so a text's score depends on the text alone, not on what shares its batch.
    """
    table, power = on_grid(model["table"])
    model["table"] = table.astype(np.float32)  # 21 bits fit
    for k in range(len(WIDTHS)):
        model["filters"][k], own = on_grid(model["filters"][k])
        step = max(power + own, -20)
        model["bias"][k] = np.ldexp(np.rint(np.ldexp(model["bias"][k].astype(np.float64), -step)), step)


def logits(model: dict, pooled: np.ndarray) -> np.ndarray:
    """One filter after the other, so that each text's sum has one order."""
    total = np.full(len(pooled), float(model["out_bias"]))
    for j, w in enumerate(model["out"].tolist()):
        total += pooled[:, j].astype(np.float64) * w
    return total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def gradients(model: dict, toks: np.ndarray, off: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """``(g, hit, table_grad)``: of the mean weighted log loss, by parameter; of the embeddings the rows in use alone.

    Errors flow only through the words that pooling chose.
    """
    kind = model["table"].dtype
    pooled, spots, x = forward(model, toks, off, where=True)
    d = (share * (sigmoid(logits(model, pooled)) - y) / len(y)).astype(kind)
    g: dict[str, object] = {"out": pooled.T @ d, "out_bias": d.sum()}
    d_pool = d[:, None] * model["out"][None, :]
    rows_hit, grads = [np.zeros(0, np.int64)], [np.zeros((0, DIM), kind)]
    for k, w in enumerate(WIDTHS):
        part = slice(k * FILTERS, (k + 1) * FILTERS)
        t, f = np.nonzero(spots[:, part] >= 0)
        at, dv = spots[:, part][t, f], d_pool[:, part][t, f]
        f_grad = np.zeros((w, DIM, FILTERS), kind)
        kernel = model["filters"][k].reshape(w, DIM, FILTERS)
        for j in range(w):
            np.add.at(f_grad[j].T, f, x[at + j] * dv[:, None])
            dx = kernel[j][:, f].T * dv[:, None]
            rows_hit += [toks[at + j, 0], toks[at + j, 1]]
            grads += [dx, dx]
        g[f"filters{k}"] = f_grad.reshape(w * DIM, FILTERS)
        g[f"bias{k}"] = np.bincount(f, dv, FILTERS).astype(kind)
    hit, inverse = np.unique(np.concatenate(rows_hit), return_inverse=True)
    table_grad = np.zeros((len(hit), DIM), kind)
    np.add.at(table_grad, inverse, np.concatenate(grads))
    return g, hit, table_grad


def fit(rows: list[dict], epochs: int = 6, batch: int = 64, rate: float = 0.005, seed: int = 5) -> dict:
    """A model from ``label, total, text`` rows by Adam over batches; a quarter of them sets slope and shift.  ``learned``: the other rows' numbers.

    Errors flow only through the words that pooling chose.  Classes weigh as their totals.  Without both labels the score is the
    share of label 1, or 0.
    """
    model = start_model(seed)
    y = np.array([r["label"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        model["out_bias"] = np.float32(4.0 if len(rows) and y[0] else -4.0)
        settled(model)
        return model
    share = np.array([r["total"] for r in rows], float) / np.bincount(y.astype(int))[y.astype(int)]
    share *= len(rows) / share.sum()
    shuffle = np.random.default_rng(seed)
    order = shuffle.permutation(len(rows))
    fitted, checked = order[len(rows) // 4 :], order[: len(rows) // 4]
    cache = [tokens(pa.array([r["text"]], pa.large_string()))[0] for r in rows]
    model["learned"] = np.sort(fitted)
    model["out_bias"] = np.float32(-3)
    names = ["out", "out_bias", "table"] + [f"{p}{k}" for p in ("filters", "bias") for k in range(len(WIDTHS))]
    get = lambda n: model[n] if n in model else model[n[:-1]][int(n[-1])]
    m, v = {n: np.zeros_like(get(n)) for n in names}, {n: np.zeros_like(get(n)) for n in names}
    step = 0
    for _ in range(epochs):
        shuffle.shuffle(fitted)
        for a in range(0, len(fitted), batch):
            ids = fitted[a : a + batch]
            off = np.concatenate([[0], np.cumsum([len(cache[i]) for i in ids])])
            toks = np.concatenate([cache[i] for i in ids])
            g, hit, table_grad = gradients(model, toks, off, y[ids], share[ids])
            step += 1
            for n in names:
                if n == "table":  # only the rows in use move
                    mm, vv = m[n][hit] * 0.9 + 0.1 * table_grad, v[n][hit] * 0.99 + 0.01 * table_grad**2
                    m[n][hit], v[n][hit] = mm, vv
                    model["table"][hit] -= rate * mm / (np.sqrt(vv) + 1e-7)
                    model["table"][PAD] = 0
                    continue
                m[n] = m[n] * 0.9 + 0.1 * np.asarray(g[n])
                v[n] = v[n] * 0.99 + 0.01 * np.asarray(g[n]) ** 2
                move = (rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
                if n in model:
                    model[n] = model[n] - move
                else:
                    model[n[:-1]][int(n[-1])] = model[n[:-1]][int(n[-1])] - move
    settled(model)
    calibrate(model, [rows[i] for i in checked], [cache[i] for i in checked], share[checked])
    return model


def calibrate(model: dict, rows: list[dict], cache: list[np.ndarray], share: np.ndarray) -> None:
    """Set slope and shift of the logits on rows that the filters have not seen."""
    y = np.array([r["label"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return
    z = np.concatenate([logits(model, forward(model, c, np.array([0, len(c)]))[0]) for c in cache])
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a pull towards slope 1 and shift 0
        p = sigmoid(a * z + b)
        e, h = share * (p - y), share * p * (1 - p) + 1e-6
        grad = np.array([(e * z).sum() + 5 * (a - 1), e.sum() + 5 * b])
        hess = np.array([[(h * z * z).sum() + 5, (h * z).sum()], [(h * z).sum(), h.sum() + 5]])
        da, db = np.linalg.solve(hess, grad)
        a, b = max(0.05, a - np.clip(da, -1, 1)), b - np.clip(db, -1, 1)
    model["scale"] = (float(a), float(b))


def thresholds(counts: list[tuple[str, int, int, int]], totals: dict[int, int], counted: dict[int, int] | None = None) -> dict[str, float]:
    """Each language's threshold of the best F1 from ``lang, label, step, count``: a score of ``step`` passes so many values of the grid.

    Labels weigh as ``totals``, the numbers of all labelled rows: the rows counted, here or in all languages (``counted``), can have other shares.
    """
    rows, found = [0, 0], {}
    for lang, label, step, n in counts:
        rows[label] += n
        found.setdefault(lang, np.zeros((2, len(GRID) + 1)))[label, step] += n
    rows = rows if counted is None else [counted.get(y, 0) for y in (0, 1)]
    weight = np.array([totals.get(y, 0) / max(1, rows[y]) for y in (0, 1)])[:, None]
    out = {}
    for lang in sorted(found.keys() - {None}):
        seen = found[lang]
        if seen[1].sum() < 5:
            continue  # too few: the default stays
        share = seen * weight
        above = share[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]  # from each threshold up
        f1 = 2 * above[1] / np.maximum(1e-9, above.sum(axis=0) + share[1].sum())
        # Of equally good thresholds the one nearest to the default.
        out[lang] = min((abs(t - DEFAULT_THRESHOLD), t) for t, f in zip(GRID, f1.tolist(), strict=True) if f >= f1.max() - 1e-9)[1]
    return out


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, learn: Column | None = None, learn_bytes: int = labelled.LEARN_BYTES, sample_bytes: int = labelled.SAMPLE_BYTES
) -> str:
    """Fit on at most ``per_class`` labelled rows of each label among those where ``learn`` holds; the model's URI.

    The sample's texts have at most ``learn_bytes`` bytes each and ``sample_bytes`` together.  Thresholds come from counts over all such
    rows, but for ids that the filters learned from.  Of documents that repeat an id the filters see one; the
    thresholds count each.  Rows without id or text and labels other than 0 and 1 teach nothing; other columns are not read.
    """
    spark = docs.sparkSession
    rows = labelled.sample(docs, labels, label, per_class, learn, ("lang",), None, learn_bytes, sample_bytes)
    model = fit(rows)
    learned = [rows[i]["doc_id"] for i in model.pop("learned").tolist()]
    uri = labelled.save(spark, model, "toxicity")
    if not learned:
        return uri
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    known = (known if learn is None else known.where(learn)).distinct()
    ids = spark.createDataFrame([(i,) for i in learned], StructType([StructField("doc_id", docs.schema["doc_id"].dataType)]))
    # Scored before they are joined: only ids, steps and languages move.
    step = sum((F.col("score") >= t).cast("int") for t in GRID)
    scored = score(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()), uri).select("doc_id", "lang", step.alias("step"))
    counts = stash(scored.join(known, "doc_id").join(F.broadcast(ids), "doc_id", "left_anti").groupBy("lang", "label", "step").count(), "toxicity-counts")
    totals = {r["label"]: r["total"] for r in rows}
    counted = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("count").alias("n")).collect()}

    def best(group: pa.Table) -> pa.Table:
        found = thresholds([(r["lang"], r["label"], r["step"], r["count"]) for r in group.to_pylist()], totals, counted)
        return pa.table({"lang": pa.array(list(found), group.schema.field("lang").type), "threshold": pa.array(list(found.values()), pa.float64())})

    # One language at a time, in tasks: there may be as many as rows.
    found = counts.where("lang is not null").groupBy("lang").applyInArrow(best, f"lang {docs.schema['lang'].dataType.simpleString()}, threshold double")
    model["thresholds"] = f"{new_folder(spark, 'toxicity-thresholds')}/t"
    found.write.parquet(model["thresholds"])
    return labelled.save(spark, model, "toxicity")


def score(docs: DataFrame, uri: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` per row.  Whole texts are scored; null and empty texts have the score of no words."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = labelled.load(uri)
        a, b = model["scale"]
        for batch in chunks(batches, "text", 1 << 19):
            pooled, _, _ = forward(model, *tokens(batch.column(1)))
            found = [1 / (1 + math.exp(-z)) for z in np.clip(a * logits(model, pooled) + b, -40, 40).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), *batch.columns[2:]], ["doc_id", "score", *batch.schema.names[2:]])

    extra = [c for c in ("lang",) if c in docs.columns]
    schema = f"doc_id {kind}, score double" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *extra).mapInArrow(rows, schema)


def languages(spark, uri: str) -> DataFrame | None:
    """``lang, threshold`` of the languages that have one of their own; None if none was learned."""
    path = labelled.load(uri)["thresholds"]
    return spark.read.parquet(path) if path else None


def flagged(scored: DataFrame, uri: str) -> DataFrame:
    """``scored`` with ``flagged``: whether ``score`` reaches the threshold of ``lang``, or ``DEFAULT_THRESHOLD``."""
    own = languages(scored.sparkSession, uri)
    if own is None:
        return scored.withColumn("flagged", F.col("score") >= DEFAULT_THRESHOLD)
    named = own.select(F.col("lang").alias("_lang"), "threshold")
    both = scored.join(named, F.col("lang") == F.col("_lang"), "left")
    return both.withColumn("flagged", F.col("score") >= F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD))).drop("_lang", "threshold")
